"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 counts the filter cells that the texts' 64-bit hashes fall into; only
(cell, count) pairs move, pre-aggregated. Cells met twice or more become
bitmaps of a fixed number of bits, broadcast (128 MB at most). In pass 2 a row
whose cells are not both repeated has no equal anywhere and passes straight
through; only the others shuffle, and are compared by SHA-256. A filter that
is too small for its rows lets more rows shuffle, and changes no result.

Defined cases: a null text counts as empty and equals empty texts; null ids
are smaller than any id; rows that repeat text and id are one document to
``mark_copies`` (all of them ``kept``, if theirs is the largest id) while
``drop_copies`` keeps exactly one row; an empty table gives an empty result;
other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

_P = "_dedup_"


def _flagged(docs: DataFrame, hashed: str, rows: int, bits_per_row: int) -> DataFrame:
    """``docs`` with the boolean ``_dedup_maybe``: the 64-bit hash in the column ``hashed`` is possibly repeated."""
    bits = common.filter_bits(rows, bits_per_row)
    repeated = (
        docs.select(F.explode(F.array(*common.cells(F.col(hashed), bits))).alias("cell"))
        .groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    )
    bitmaps = common.bitmap_table(repeated, "repeated-cells")
    one, two = common.cells(F.col(hashed), bits)
    probed = common.probe(docs.withColumns({_P + "c1": one, _P + "c2": two}), [_P + "c1", _P + "c2"], bitmaps, _P + "maybe")
    return probed.drop(_P + "c1", _P + "c2")


def mark_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits_per_row: int = 16,
    expected_rows: int | None = None, normalise=lambda c: c,
) -> DataFrame:
    """Every row's id with ``keep_id, group_size, kept, text_sha256``. ``normalise``: a Column to Column function of the text.

    The texts are scanned once, for ids and hashes, which are written; both passes work on those.
    """
    whole = normalise(F.coalesce(F.col(common.quoted(text)), F.lit("")))
    digests = docs.select(F.col(common.quoted(doc_id)).alias("doc_id"), F.xxhash64(whole).alias("hash"), F.sha2(whole, 256).alias("text_sha256"))
    digests, seen = common.measured(digests, "text-digests", rows=F.count(F.lit(1)))
    rows = seen["rows"] if expected_rows is None else expected_rows
    flagged = _flagged(digests, "hash", rows, bits_per_row).select("doc_id", "text_sha256", _P + "maybe")
    alone = flagged.where(~F.col(_P + "maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # The few rows that may have an equal are written, as both sides of their join read them.
    met = common.written(flagged.where(_P + "maybe").select("doc_id", "text_sha256"), "maybe-copies")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(common.salts_for(rows)))
    met = common.with_group_stats(met, ["text_sha256"], {"keep_id": ("max", F.col("doc_id")), "group_size": ("count", F.lit(1))}, salt)
    return alone.unionByName(met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits_per_row: int = 16,
    expected_rows: int | None = None, normalise=lambda c: c,
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id; same columns.

    Rows without an equal are never shuffled. The others meet by text hash in an
    aggregate that keeps one row for each task and text before the shuffle.
    """
    rows = docs.count() if expected_rows is None else expected_rows
    whole = normalise(F.coalesce(F.col(common.quoted(text)), F.lit("")))
    packed = common.packed(docs, id=F.col(common.quoted(doc_id)), text=whole, hash=F.xxhash64(whole))
    flagged = _flagged(packed, "hash", rows, bits_per_row)
    alone = flagged.where(~F.col(_P + "maybe")).select("_row")
    best = (
        flagged.where(_P + "maybe")
        .groupBy(F.sha2("text", 256).alias("sha"))
        .agg(F.max_by("_row", F.struct(F.col("id").isNotNull(), F.col("id"))).alias("_row"))
        .select("_row")
    )
    return alone.union(best).select("_row.*")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
