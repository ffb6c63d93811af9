"""Helpers shared by the corpus operators: shared-folder tables, salted group
statistics, and a native Bloom filter kept as bitmaps."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes handed to Python at once; one row may be larger.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20
#: Bits of one row of a filter: the width that Spark's bitmap functions use.
BITMAP_BITS = 32768
#: A filter never has more bits than this, so its broadcast never exceeds 128 MB.
MAX_FILTER_BITS = 1 << 30

#: Tables in the shared folder, with their sessions.
_made: dict[str, SparkSession] = {}
#: Temporary folders by application, where no shared one is named.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _own_dirs[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted by ``drop`` or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith(("/", "file:")):  # also after the session has stopped
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for path, spark in _made.items():
        _delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` or ``measured`` that nothing reads any more."""
    for table in tables:
        if spark := _made.pop(getattr(table, "_written_to", ""), None):
            _delete(spark, table._written_to)


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    ``file_rows``: rows of a file at most (0: any number). Rows of large arrays need
    it, as Spark decodes up to 4,096 rows of a file at once, whatever their size.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def measured(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of the rows (null sums as 0) that are taken while they are written."""
    seen = Observation()
    back = written(df.observe(seen, *[c.alias(k) for k, c in facts.items()]), name)
    got = seen.get
    return back, {k: got.get(k) or 0 for k in facts}


def within_bytes(sample: DataFrame, text: str, group: str, order: str, limit: int) -> DataFrame:
    """The rows of a sample that come, in the order within their group, before its texts have more than ``limit`` bytes together.

    Each row counts 64 bytes besides its text; one of more than the limit by
    itself is passed over. Only lengths meet by group. The sample is written, and
    must have a bounded number of different orders in a group.
    """
    sized = sample.withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64)
    kept = written(sized.where(F.col("_bytes") <= limit), "sample")
    lengths = kept.groupBy(group, order).agg(F.sum("_bytes").alias("_bytes"))
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fits = lengths.select(group, order, F.sum("_bytes").over(so_far).alias("_so_far")).where(F.col("_so_far") <= limit)
    return kept.join(F.broadcast(fits.select(group, order)), [group, order], "left_semi").drop("_bytes")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of Python stages, unless the session sets a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def with_input(rows: DataFrame, column: str, made: str, keep: bool = True) -> tuple[DataFrame, T.StructType, Callable[[DataFrame], DataFrame]]:
    """For a Python stage that makes columns of one input column: (its input, its output schema, what unpacks its output).

    The input has the kept columns as one struct, whatever their names, and the
    input column last; the stage puts the made columns in that one's place. A
    column of ``rows`` that has the name of a made one is replaced by it; the
    input column itself is kept too unless ``keep`` is false.
    """
    fields = T._parse_datatype_string(made).fields
    names = {f.name for f in fields}
    kept = [F.col(quoted(c)) for c in rows.columns if c not in names and (keep or c != column)]
    base = rows.select(F.struct(*(kept or [F.lit(0).alias("_none")])).alias("_row"), F.col(quoted(column)).alias("_input"))
    out = [*(["_row.*"] if kept else []), *[F.col(quoted(f.name)) for f in fields]]
    return base, T.StructType([base.schema["_row"], *fields]), lambda df: df.select(*out)


def packed(rows: DataFrame, **extra: Column) -> DataFrame:
    """Each row as one struct ``_row`` beside extra columns, so that names of its columns can't clash with any other."""
    return rows.select(F.struct(*columns_of(rows)).alias("_row"), *[c.alias(n) for n, c in extra.items()])


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def salts_for(rows: int) -> int:
    """Parts that one key's rows are dealt to: 64, and more from 64 million rows on."""
    return max(64, min(1 << 16, 1 << max(0, (rows // 1_000_000) - 1).bit_length()))


def with_group_stats(rows: DataFrame, keys: list[str], stats: dict[str, tuple[str, Column]], salt: Column) -> DataFrame:
    """``rows`` with statistics of their key group, never gathering a group in one task.

    ``stats``: name -> (one of count, sum, min, max; column). Rows are first
    reduced to one row for each (key, salt), those meet by key (as many rows
    as there are salts at most), and the result goes back by (key, salt).
    ``keys`` must not be null. ``salt`` must be a function of the row's values.
    """
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    salted = rows.withColumn("_salt", salt)
    parts = salted.groupBy(*keys, "_salt").agg(*[first[kind](c).alias(f"_{name}") for name, (kind, c) in stats.items()])
    whole = Window.partitionBy(*keys)
    parts = parts.select(*keys, "_salt", *[merge[kind](f"_{name}").over(whole).alias(name) for name, (kind, _) in stats.items()])
    return salted.join(parts, [*keys, "_salt"]).drop("_salt")


def filter_bits(rows: int, bits_per_row: int = 16) -> int:
    """Bits of a filter for ``rows`` keys: a power of two within [2^15, 2^30]."""
    return max(BITMAP_BITS, min(MAX_FILTER_BITS, 1 << max(1, rows * bits_per_row - 1).bit_length()))


def cells(key_hash: Column, bits: int) -> list[Column]:
    """The two cells of a 64-bit hash."""
    return [key_hash.bitwiseAND(bits - 1).cast("int"), F.shiftrightunsigned(key_hash, 33).bitwiseAND(bits - 1).cast("int")]


def bitmap_table(cell_rows: DataFrame, name: str) -> DataFrame:
    """(bucket, bits) from one column ``cell``; at most bits / 32768 rows of 4 KB. Written, as several branches use it."""
    made = cell_rows.groupBy(F.expr(f"cell div {BITMAP_BITS}").cast("int").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(cast(cell % {BITMAP_BITS} as bigint))").alias("bits")
    )
    return written(made, name)


def probe(rows: DataFrame, cell_names: list[str], bitmaps: DataFrame, out: str) -> DataFrame:
    """Adds the boolean ``out``: whether every named cell is set. The bitmaps are broadcast; MAX_FILTER_BITS bounds them."""
    found = F.lit(True)
    for i, cell in enumerate(cell_names):
        one = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}")))
        rows = rows.join(one, F.expr(f"cast({cell} div {BITMAP_BITS} as int)") == F.col(f"_bucket{i}"), "left")
        byte = F.expr(f"cast(conv(hex(substring(_bits{i}, cast(({cell} % {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
        rows = rows.withColumn(f"_set{i}", F.coalesce(F.call_function("shiftright", byte, F.col(cell) % 8).bitwiseAND(1) == 1, F.lit(False)))
        rows = rows.drop(f"_bucket{i}", f"_bits{i}")
        found = found & F.col(f"_set{i}")
    return rows.withColumn(out, found).drop(*[f"_set{i}" for i in range(len(cell_names))])


def bloom_of(keys: DataFrame, key: str, bits: int, name: str) -> DataFrame:
    """Bitmaps of a Bloom filter with the values of the 64-bit hash column ``key``."""
    return bitmap_table(keys.select(F.explode(F.array(*cells(F.col(key), bits))).alias("cell")), name)
