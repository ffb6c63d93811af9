"""Tables whose versions stand beside each other, published by a manifest.

A version is written whole to a folder of its own and then named by a new, empty
file ``<number>-<folder>`` under ``_published``, which a file system makes at once or
not at all. Readers take the highest name when they plan, so a refresh never
touches what they read; of two writers of one number, the higher name is current.
Old versions go by ``prune`` only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

PUBLISHED = "_published"


def _target(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def published(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions, the current one last."""
    fs, path = _target(spark, f"{root}/{PUBLISHED}")
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def publish(df: DataFrame, root: str, fmt: str = "parquet", partition_by: Sequence[str] = (), order: Sequence[str] = ()) -> str:
    """Writes a version and makes it current. ``partition_by``: a folder for each value; ``order``: rows of a value are split over tasks by these, and sorted."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    if partition_by or order:
        df = df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{root}/{name}")
    last = published(spark, root)
    number = int(last[-1].split("-")[0]) + 1 if last else 1
    fs, path = _target(spark, f"{root}/{PUBLISHED}/{number:012}-{name}")
    fs.mkdirs(path.getParent())
    fs.createNewFile(path)
    return name


def current(spark: SparkSession, root: str) -> str | None:
    """Path of the current version; None where nothing is published."""
    names = published(spark, root)
    return f"{root}/{names[-1].split('-', 1)[1]}" if names else None


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the last ``keep`` versions; frames planned on the others can't be read any more."""
    for name in published(spark, root)[: -max(1, keep)]:
        for part in (f"{root}/{PUBLISHED}/{name}", f"{root}/{name.split('-', 1)[1]}"):
            fs, path = _target(spark, part)
            fs.delete(path, True)
