"""Tables between steps, in the folder that all executors share.

Work that needs a frame twice in the same order, or is worth no recomputing
after a lost executor, writes it here and reads it back.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that were made, with their sessions; and the temporary folder of each application that names no shared one.
_paths: dict[str, SparkSession] = {}
_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder on a local master, and an error on any other (``local-cluster`` too)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _folders[app], ignore_errors=True)
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, deleted when the driver's Python ends."""
    if not _paths:
        atexit.register(clear)
    path = f"{folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _paths[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: its rows, their order within tasks and its random draws are then fixed."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(path: str) -> None:
    """Deletes what is at a path of ``new_path``."""
    spark = _paths.pop(path, None)
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):  # works after the session has stopped, too
        shutil.rmtree(local, ignore_errors=True)
    elif spark is not None:
        with contextlib.suppress(Exception):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear() -> None:
    for path in list(_paths):
        delete(path)
