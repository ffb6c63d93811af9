"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Steps:
1. One pass over the texts makes, for each row, a 128-bit fingerprint of its
   set of word n-grams and one hash for each band of its MinHash signature.
   Rows with equal sets become one class of copies before anything else.
2. Classes meet on band hashes. Only buckets of two classes or more go on, and
   of those none that lies within one earlier bucket of all its members.
3. Within a bucket, the pairs whose first common band it is are verified on
   their full n-gram sets, so each pair that shares a band is verified once and
   no other is. A bucket is dealt to blocks of a bounded number of texts and
   bytes, and a task takes one pair of blocks, so no task gathers a bucket.
4. A task returns the number of links of each class and its links' connected
   classes as stars (fewer edges than classes); those stars are joined to groups.

Bands and rows follow from the recall wanted at the threshold: the most rows
for a band whose number of bands keeps the hashes within a budget.

Defined cases: words are those of ``words.py``; a text with fewer than n words
has one n-gram, all its words; a null or empty text, or one without words, has
no n-gram, links to nothing and is its own class; null ids come after all
others when a class is named by its smallest id; repeated rows count as copies
each; a text longer than a block's bytes is a block of its own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, words
from tidemark.llm.components import connected

U = np.uint64
NGRAM, THRESHOLD, RECALL, MAX_HASHES, SEED = 5, 0.8, 0.9999, 128, 20240229
#: Texts and bytes of text of a block; a task verifies one pair of blocks.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows r with b = ceil(log(1 - recall) / log(1 - threshold^r)) bands and b * r <= max_hashes.

    More rows for a band make fewer false candidates at the same recall.
    """
    best = None
    for r in range(1, max_hashes + 1):
        b = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r))) if threshold < 1 else 1
        if b * r <= max_hashes:
            best = b, r
    if best is None:
        raise ValueError("no number of bands reaches this recall within the hashes allowed")
    return best


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, np.int64).astype(U) * U(2) + U(1), rng.integers(0, 1 << 63, n, np.int64).astype(U)


def signatures(shingles: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, (texts with a shingle, n)."""
    a, b = _multipliers(n)
    full = counts[counts > 0]
    at = np.concatenate(([0], np.cumsum(full)[:-1]))
    out = np.empty((full.size, n), U)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((shingles ^ b[i]) * a[i], at)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): a hash of the band's number and its values."""
    h = np.broadcast_to(np.arange(bands, dtype=U) + U(1), (signature.shape[0], bands)).copy()
    for r in range(rows):
        h = words.mix((h ^ signature[:, r : bands * rows : rows]) * U(0x9E3779B97F4A7C15) + U(r))
    return h


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketcher(text: str, n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            prints: list = []
            sizes: list = []
            lists: list = []
            for hashes, counts in words.word_hashes(texts):
                shingles, each = words.shingle_hashes(hashes, counts, n)
                at = np.concatenate(([0], np.cumsum(each)))
                sets = [np.unique(shingles[at[i] : at[i + 1]]) for i in range(each.size)]
                made = iter(band_hashes(signatures(shingles, each, bands * rows), bands, rows).view(np.int64)) if shingles.size else iter(())
                for s in sets:
                    prints.append(_digest(s) if s.size else None)
                    sizes.append(s.size)
                    lists.append(next(made) if s.size else None)
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text]
            names = [name for name in batch.schema.names if name != text]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], [*names, "fp", "n_grams", "bands"]
            )

    return run


def sketch(docs: DataFrame, text: str, doc_id: str, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row_key, bytes, fp, n_grams, bands) for each row; fp and bands are null where there is no n-gram.

    row_key: 128 bits of text and id (``_row_key``), to find the row again without reading the whole text's n-grams.
    """
    common.small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.octet_length(whole).cast("long").alias("bytes"), whole.alias("text"))
    return rows_in.mapInArrow(_sketcher("text", n, bands, rows), "doc_id long, row_key struct<a:bigint,b:bigint>, bytes long, fp binary, n_grams int, bands array<long>")


def _filter_hash(text: Column, doc_id: Column) -> Column:
    return F.xxhash64(text, doc_id)


def _row_key(doc_id: Column, text: Column) -> Column:
    """Two 64-bit hashes of text and id by different seeds: ``a`` alone places the row in filters, both together tell rows apart."""
    whole, number = F.coalesce(text, F.lit("")), doc_id.cast("long")
    return F.struct(_filter_hash(whole, number).alias("a"), F.xxhash64(F.lit("row"), whole, number).alias("b"))


def _classes(sketches: DataFrame) -> DataFrame:
    """One row for each distinct n-gram set: fp, its copies, the smallest id, and that row's key and bytes."""
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"), F.col("bytes"))
    return (
        sketches.where("fp is not null").groupBy("fp")
        .agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .select("fp", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("row_key"), F.col("first.bytes").alias("bytes"), "n_grams", "bands")
    )


def _buckets(classes: DataFrame) -> DataFrame:
    """(fp, band, members, bucket_bytes): each class in each of the buckets that it has to be verified in.

    Buckets are counted first, pre-aggregated, and only classes in buckets of
    two or more go on; the join that picks them has a bucket's count on one side,
    so a hot bucket can be split. A bucket is left out when all its members
    have the same first bucket and it is another one: their pairs are verified there.
    """
    members = classes.select("fp", "bytes", F.posexplode("bands").alias("k", "band"))
    counted = members.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bucket_bytes")).where("members > 1")
    met = members.drop("bytes").join(common.written(counted, "repeated-bands"), "band")
    own = Window.partitionBy("fp").orderBy("k")
    met = common.written(met.withColumn("first", F.first("band").over(own)), "bucket-members")
    within = met.groupBy("band", "members", "first").agg(F.count(F.lit(1)).alias("n")).where("n = members and first <> band")
    return met.join(within.select("band"), "band", "left_anti").select("fp", "band", "members", "bucket_bytes")


def _tasks(buckets: DataFrame, classes: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(band, i, j, block, fp, copies, n_grams, row_key, bands): every class of a bucket, once for each pair of blocks that it takes part in.

    A bucket of one block has the pair (0, 0).
    """
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("bucket_bytes") / F.lit(block_bytes))).cast("int")
    dealt = buckets.select("fp", "band", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    whole = dealt.join(classes.select("fp", "copies", "n_grams", "row_key", "bands"), "fp").withColumn("pair", F.explode(pairs))
    return whole.select("band", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "fp", "copies", "n_grams", "row_key", "bands")


def _links_in(threshold: float, n: int, want_pairs: bool):
    """Verifies the pairs of a pair of blocks of a bucket whose first common band the bucket's is. Input rows: those of ``_tasks`` with their text."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key
        frame = frame.sort_values(["block", "fp"], kind="stable").reset_index(drop=True)
        block, copies, fp, size = (frame[c].to_numpy() for c in ("block", "copies", "fp", "n_grams"))
        bands = np.stack(frame["bands"].to_list())
        before = bands[:, : int(np.flatnonzero(bands[0] == band)[0])]
        right = np.flatnonzero(block == j)
        # Candidates by sizes and bands alone; only their texts are cut into n-grams.
        candidates, needed = [], np.zeros(size.size, bool)
        for a in np.flatnonzero(block == i).tolist():
            other = right[right > a] if i == j else right
            other = other[np.minimum(size[other], size[a]) >= threshold * np.maximum(size[other], size[a]) - 1e-9]
            other = other[~(before[other] == before[a]).any(axis=1)]
            if other.size:
                candidates.append((a, other))
                needed[other] = needed[a] = True
        sets = []
        for hashes, counts in words.word_hashes(frame["text"][needed].tolist()):
            shingles, each = words.shingle_hashes(hashes, counts, n)
            at = np.concatenate(([0], np.cumsum(each)))
            sets += [np.unique(shingles[at[k] : at[k + 1]]) for k in range(each.size)]
        start = np.zeros(size.size, np.int64)
        start[needed] = np.cumsum(size[needed]) - size[needed]
        distinct, ids = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0, U), np.empty(0, np.int64))
        del sets
        inside = np.zeros(distinct.size, bool)
        found = np.zeros(size.size, np.int64)
        parent = list(range(size.size))
        pairs: list[tuple[bytes, bytes, float]] = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, other in candidates:
            inside[ids[start[a] : start[a] + size[a]]] = True
            ends = np.cumsum(size[other])
            where = np.repeat(start[other] - (ends - size[other]), size[other]) + np.arange(ends[-1])
            both = np.add.reduceat(inside[ids[where]], ends - size[other], dtype=np.int64)
            inside[ids[start[a] : start[a] + size[a]]] = False
            jaccard = both / (size[a] + size[other] - both)
            near = jaccard >= threshold
            met = other[near]
            found[a] += copies[met].sum()
            found[met] += copies[a]
            if want_pairs:
                pairs += [(fp[a], fp[b], x) for b, x in zip(met.tolist(), jaccard[near].tolist(), strict=True)]
            for b in met.tolist():
                one, two = root(a), root(b)
                if one != two:
                    low, high = (one, two) if fp[one] < fp[two] else (two, one)
                    parent[high] = low
        if not want_pairs:
            pairs = [(fp[k], fp[root(k)], None) for k in range(size.size) if root(k) != k]
        linked = np.flatnonzero(found).tolist()
        rows = [(x, y, v, 0) for x, y, v in pairs] + [(fp[k], None, None, int(found[k])) for k in linked]
        return pd.DataFrame(rows, columns=["a", "b", "jaccard", "links"])

    return run


def _verified(docs: DataFrame, text: str, doc_id: str, classes: DataFrame, n: int, threshold: float, block: int, block_bytes: int, want_pairs: bool) -> DataFrame:
    """Rows (a, b, jaccard, links): links between classes (stars of connected ones, or all), and the link totals of a task (b null)."""
    tasks, made = common.measured(_tasks(_buckets(classes), classes, block, block_bytes), "block-pairs", n=F.count(F.lit(1)))
    # Only rows that stand for a class in a bucket pass this filter with their text, and only they shuffle.
    bits = common.filter_bits(max(1, made["n"]), 16)
    bitmaps = common.bloom_of(tasks.select(F.col("row_key.a").alias("a")).distinct(), "a", bits, "wanted-rows")
    one, two = common.cells(F.col("row_key.a"), bits)
    wanted = docs.select(_row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"c1": one, "c2": two})
    wanted = common.probe(wanted, ["c1", "c2"], bitmaps, "maybe").where("maybe").groupBy("row_key").agg(F.first("text").alias("text"))
    with_text = tasks.join(wanted, "row_key").select("band", "i", "j", "block", "fp", "copies", "n_grams", "bands", "text")
    return with_text.groupBy("band", "i", "j").applyInPandas(_links_in(threshold, n, want_pairs), "a binary, b binary, jaccard double, links long")


def _sketched(docs: DataFrame, text: str, doc_id: str, n: int, threshold: float, recall: float, max_hashes: int) -> tuple[DataFrame, DataFrame, int]:
    """(sketches, classes, rows), both written."""
    bands, per_band = bands_for(threshold, recall, max_hashes)
    sketches, made = common.measured(sketch(docs, text, doc_id, n, bands, per_band), "sketches", rows=F.count(F.lit(1)))
    return sketches, common.written(_classes(sketches), "classes"), made["rows"]


def near_duplicate_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD,
    recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, copies, n_grams, row_key.

    class_id: the smallest doc_id of the rows connected by links (Jaccard of
    n-gram sets >= threshold) or equal sets. n_links: how many other rows have a
    Jaccard of at least the threshold with it, rows with an equal set included.
    """
    sketches, classes, rows = _sketched(docs, text, doc_id, n, threshold, recall, max_hashes)
    found = common.written(_verified(docs, text, doc_id, classes, n, threshold, block, block_bytes, False), "links")
    groups = connected(found.where("b is not null").select("a", "b"), "group").withColumnRenamed("node", "fp")
    totals = found.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    facts = classes.select("fp", "copies", "first_id", "n_grams", "row_key")
    named = groups.join(facts.select("fp", F.struct(F.col("first_id").isNull(), F.col("first_id")).alias("first")), "fp")
    led = common.with_group_stats(named, ["group"], {"lead": ("min", F.col("first"))}, F.pmod(F.xxhash64("fp"), F.lit(common.salts_for(rows))))
    known = facts.join(led.select("fp", "lead"), "fp", "left").join(totals, "fp", "left")
    leader = F.when(F.col("lead").isNull(), F.col("first_id")).otherwise(F.col("lead.first_id"))
    known = known.select("fp", "first_id", "n_grams", "row_key", leader.alias("class_id"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return _back(sketches, common.written(known, "class-facts"))


def _back(sketches: DataFrame, known: DataFrame) -> DataFrame:
    """Class facts to every row. A class of one row is that row; the rows of others meet their class in a join whose large side can be split."""
    names = ["doc_id", "class_id", "n_links", "copies", "n_grams", "row_key"]
    single = known.where("copies = 1").withColumnRenamed("first_id", "doc_id").select(*names)
    copied = known.where("copies > 1").select("fp", "class_id", "n_links", "copies")
    several = sketches.where("fp is not null").select("fp", "doc_id", "n_grams", "row_key").join(copied, "fp").select(*names)
    none = sketches.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), "n_grams", "row_key")
    return single.unionByName(several).unionByName(none)


def similar_pairs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, threshold: float = THRESHOLD,
    recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every link between distinct n-gram sets: id_a, id_b (their smallest ids), jaccard.

    The number of pairs is the square of a group's distinct texts; ask for
    ``near_duplicate_classes`` where counts and classes are enough.
    """
    _, classes, _ = _sketched(docs, text, doc_id, n, threshold, recall, max_hashes)
    found = _verified(docs, text, doc_id, classes, n, threshold, block, block_bytes, True).where("b is not null")
    ids = classes.select("fp", "first_id")
    both = found.join(ids.select(F.col("fp").alias("a"), F.col("first_id").alias("ia")), "a").join(ids.select(F.col("fp").alias("b"), F.col("first_id").alias("ib")), "b")
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "jaccard")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class: that whose id names the class, same columns.

    Rows to drop are found by a Bloom filter first, so the others pass without a
    shuffle. Of repeated rows (same id and text) that stay, one does. Rows of
    other texts that bear the staying id too all stay, and so do rows without an
    id in a class where no row has one, as nothing says which of them is it.
    """
    found = near_duplicate_classes(docs, text, doc_id, **options)
    # Of the rows in a class of several, all but one go; the rest of the table never meets them.
    marks = found.where("n_links > 0").select("row_key", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))
    marked, made = common.measured(marks, "near-copies", n=F.count(F.lit(1)))
    bits = common.filter_bits(max(1, made["n"]), 16)
    bitmaps = common.bloom_of(marked.select(F.col("row_key.a").alias("a")), "a", bits, "near-copy-rows")
    one, two = common.cells(F.col("row_key.a"), bits)
    keyed = common.packed(docs, row_key=_row_key(F.col(common.quoted(doc_id)), F.col(common.quoted(text))))
    probed = common.probe(keyed.withColumns({"c1": one, "c2": two}), ["c1", "c2"], bitmaps, "maybe")
    alone = probed.where("not maybe").select("_row")
    keys = marked.groupBy("row_key").agg(F.max("stays").alias("stays"))
    met = probed.where("maybe").select("_row", "row_key").join(keys, "row_key", "left")
    single = met.where("stays is null").select("_row")
    best = met.where("stays").groupBy("row_key").agg(F.first("_row").alias("_row")).select("_row")
    return alone.union(single).union(best).select("_row.*")


#: Near-duplicate classes of ``documents`` for tables of some thousand rows: all pairs that share an n-gram, and the closure of their links.
ORACLE_SQL = r"""
WITH RECURSIVE
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM t),
k AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS fp FROM g WHERE len(s) > 0),
c AS MATERIALIZED (SELECT fp, any_value(s) AS s, any_value(n) AS n, count(*) AS copies, min(doc_id) AS first FROM k GROUP BY fp),
e AS MATERIALIZED (SELECT fp, n, unnest(s) AS x FROM c),
p AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM e a JOIN e b ON a.x = b.x AND a.fp <> b.fp GROUP BY a.fp, b.fp, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.8),
links AS (SELECT p.a AS fp, sum(c.copies) AS n FROM p JOIN c ON c.fp = p.b GROUP BY p.a),
reach AS (SELECT fp, fp AS other FROM c UNION SELECT reach.fp, p.b FROM reach JOIN p ON p.a = reach.other),
classes AS (SELECT reach.fp, min(c.first) AS class_id FROM reach JOIN c ON c.fp = reach.other GROUP BY reach.fp)
SELECT k.doc_id, classes.class_id, CAST(coalesce(links.n, 0) + c.copies - 1 AS BIGINT) AS n_links, c.copies
FROM k JOIN c ON c.fp = k.fp JOIN classes ON classes.fp = k.fp LEFT JOIN links ON links.fp = k.fp
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM g WHERE len(s) = 0
"""
