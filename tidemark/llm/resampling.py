"""Target-distribution importance resampling from a persisted sparse count matrix.

1. One pass over the whole texts makes the document-by-bucket count matrix: a
   feature is a run of ``shortest`` to ``longest`` consecutive words, its bucket
   the CRC-32 of its UTF-8 bytes modulo ``buckets``. The matrix is kept as CSR
   blocks (ids, word counts, row bounds, column indices, counts), one row of a
   table in the shared folder for each block of a bounded number of entries, and
   few of them to a file, which is what a task decodes at once.
2. Column sums of the blocks give the corpus' distribution, those of the target's
   matrix the wanted one; a bucket's gain is 1000 times the smoothed log ratio,
   floored. Only ``buckets`` numbers of each reach the driver.
3. The sparse matrix-vector product of the blocks with the gains gives each
   document's weight, its mean gain. The texts are not read again.
4. Weights plus Gumbel draws by the document's id are a sample without
   replacement by their highest values. They are ranked over range-partitioned
   parts, so no task holds all of them.

Words are maximal runs of ASCII letters, digits and characters from U+0080 on,
only A to Z lower-cased.

Defined cases: a null or empty text, or one without words, has no feature and
weight 0; texts are read whole, in pieces cut between words; null ids draw as
the id '' and come first in ties; repeated rows are ranked each; an empty table
gives an empty result, an empty target a uniform one; other columns are not read
by the scores and pass through ``resample`` whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators import blocks

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Entries of a CSR block; a document adds ``buckets`` at most. Bytes of a text cut into words at once.
BLOCK_ENTRIES, PIECE = 1 << 18, 1 << 20
#: Blocks of a file: a reader holds all of a file's, some 60 MB of decoded arrays here, however large the task's input is.
FILE_BLOCKS = 8

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

MATRIX = "ids array<long>, words array<long>, bounds array<int>, indices array<int>, counts array<long>"


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of those of about PIECE bytes each, cut between words."""
    raw = (text or "").encode("utf-8", "replace").translate(LOWER)
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield WORD.findall(raw, at, end)
        at = end


def bucket_counts(text: str | None, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets in order, their counts) of a text's features."""
    found: Counter[bytes] = Counter()
    words, held = 0, []
    for part in words_of(text):
        words += len(part)
        if longest == 1:
            found.update(part)
            continue
        run = held + part
        for n in range(shortest, longest + 1):  # runs that end in this part; words held back only begin them
            first = max(0, len(held) - n + 1)
            found.update(b" ".join(run[k : k + n]) for k in range(first, len(run) - n + 1))
        held = run[max(0, len(run) - longest + 1) :]
    if not found:
        return words, np.empty(0, np.int32), np.empty(0, np.int64)
    place = np.fromiter((zlib.crc32(w) % buckets for w in found), np.int64, len(found))
    index, inverse = np.unique(place, return_inverse=True)
    counts = np.zeros(index.size, np.int64)
    np.add.at(counts, inverse, np.fromiter(found.values(), np.int64, len(found)))
    return words, index.astype(np.int32), counts


def count_matrix(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The count matrix as CSR blocks, written: ids, words, bounds (one more than rows), indices, counts. ``doc_id`` None: all ids null."""
    common.small_batches(docs.sparkSession)
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["ids", "words", "bounds", "indices", "counts"]

    def work(batches):
        ids, words, sizes, index, counts = [], [], [0], [], []

        def block():
            joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (index, counts)]
            cells = [ids, words, np.cumsum(sizes), *joined]
            return pa.RecordBatch.from_arrays([pa.array([list(c)], k) for c, k in zip(cells, kinds, strict=True)], names)

        entries = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, i, c = bucket_counts(value.as_py(), shortest, longest, buckets)
                ids.append(key)
                words.append(n)
                sizes.append(i.size)
                index.append(i)
                counts.append(c)
                entries += i.size + 8
                if entries >= BLOCK_ENTRIES:
                    yield block()
                    ids, words, sizes, index, counts, entries = [], [], [0], [], [], 0
        if ids:
            yield block()

    key = F.lit(None) if doc_id is None else F.col(common.quoted(doc_id))
    return common.written(docs.select(key.cast("long").alias("id"), F.col(common.quoted(text)).alias("text")).mapInArrow(work, MATRIX), "bucket-counts", FILE_BLOCKS)


def _flat(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    """The numbers of one array cell."""
    cell = batch.column(column)
    return cell.values.slice(cell.offsets[k].as_py(), cell.offsets[k + 1].as_py() - cell.offsets[k].as_py()).to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all blocks: each task adds up its own, and ``buckets`` sums at most are collected."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                np.add.at(total, _flat(batch, 0, k), _flat(batch, 1, k))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = matrix.select("indices", "counts").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    all_source, all_target = float(source.sum() + source.size), float(target.sum() + target.size)
    return np.array([math.floor(1000.0 * math.log((float(t) + 1.0) * all_source / ((float(s) + 1.0) * all_target))) for s, t in zip(source, target, strict=True)], np.int64)


def weighted(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document: the blocks' product with the gains over their features, floored."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                bounds, counts = _flat(batch, 2, k), _flat(batch, 4, k)
                so_far = [np.concatenate(([0], np.cumsum(x))) for x in (counts, shared.value[_flat(batch, 3, k)] * counts)]
                features, total = [x[bounds[1:]] - x[bounds[:-1]] for x in so_far]
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)[k].as_py(), pa.int64()), pa.array(_flat(batch, 1, k)), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", shortest: int = 1, longest: int = 1,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its rank among those drawn (from 1, by score; null: not drawn).

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) are drawn.
    """
    matrix = count_matrix(docs, text, doc_id, shortest, longest, buckets)
    wanted = column_sums(count_matrix(target, target_text, None, shortest, longest, buckets), buckets)
    scored = weighted(matrix, gains(column_sums(matrix, buckets), wanted))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = scored.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(draw))))
    enough = F.col("n_words") >= least_words
    scored, seen = common.measured(scored, "importance", n=F.count_if(enough))
    drawn = percent * int(seen["n"]) // 100
    placed = blocks.positioned(scored.where(enough).withColumn("_falling", -F.col("score")), [], ["_falling"], ["doc_id", "weight", "n_features"])
    rank = F.when(F.col(blocks.POS) < drawn, F.col(blocks.POS) + 1)
    names = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*names, rank.alias("rank")).unionByName(scored.where(~enough).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with the drawn documents only; same columns. Rows that share an id stay together. ``settings``: those of ``importance_ranks``."""
    drawn = importance_ranks(docs, target, text, doc_id, **settings).where("rank is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = common.packed(docs, id=F.col(common.quoted(doc_id)).cast("long"))
    return rows.join(drawn, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 by its byte table, which is made from the reflected polynomial.
ORACLE_SQL = f"""
WITH steps AS (SELECT list(v ORDER BY n) AS t FROM (
       SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
d AS (SELECT doc_id, unnest({_WORDS_SQL.format("text")}) AS w FROM documents),
b AS (SELECT unnest({_WORDS_SQL.format("text")}) AS w FROM benchmark),
known AS (SELECT w, hex(w) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 1 + 2 * k, 2))::BIGINT)),
       lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM known, steps),
source AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY 1),
gain AS (SELECT r.bucket, CAST(floor(1000::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM source)::DOUBLE + 10000)
       / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM target)::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM range(10000) r(bucket) LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM d JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
       coalesce(weight, 0) + CAST(floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= k THEN r END AS rank FROM ranked
"""
