"""Importance resampling against a plain count of every feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, shortest, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(shortest, longest + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, buckets, shortest=1, longest=1, least=20, percent=10, seed=2024):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, shortest, longest)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        words, own = features(text, shortest, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    some = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {id(r): k for k, r in enumerate(some[: percent * len(some) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x1", "été", "a_b", "gamma"], int(k))) for k in rng.integers(0, 60, n)]


@pytest.mark.parametrize(("shortest", "longest", "piece"), [(1, 1, 1 << 20), (1, 3, 7), (2, 2, 40)])
def test_equal_to_a_plain_count(spark, monkeypatch, shortest, longest, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    docs = [*enumerate(texts(150, 1)), (None, "alpha " * 25), (7, "beta " * 30), (900, None), (901, ""), (902, "... !"), (903, "z" * 5000 + " b " * 3000)]
    target = [*texts(20, 2), None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for part in docs:  # pieces change nothing
        got = resampling.bucket_counts(part[1], shortest, longest, 50)
        want = Counter(zlib.crc32(f.encode()) % 50 for f in features(part[1], shortest, longest)[1])
        assert (got[0], dict(zip(got[1].tolist(), got[2].tolist(), strict=True))) == (len(features(part[1], 1, 1)[0]), dict(want))
    made = resampling.importance_ranks(frame, spark.createDataFrame([(t,) for t in target], "text string"), shortest=shortest, longest=longest, buckets=50)
    assert sorted((tuple(r) for r in made.collect()), key=str) == brute(docs, target, 50, shortest, longest)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(200, 3))), "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in texts(10, 4)], "text string")
    one = sorted(map(tuple, resampling.importance_ranks(docs, target).collect()), key=str)
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 30)
    assert sorted(map(tuple, resampling.importance_ranks(docs, target).collect()), key=str) == one


def test_files_of_the_matrix_hold_few_blocks(spark, monkeypatch):
    """A reader decodes a file's blocks together, so one task's many blocks must go to several files."""
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 30)
    docs = spark.createDataFrame(list(enumerate(texts(200, 3))), "doc_id long, text string").coalesce(1)
    matrix = resampling.count_matrix(docs)
    blocks = [r["count"] for r in matrix.groupBy(F.input_file_name()).count().collect()]
    assert sum(blocks) > 50 and max(blocks) <= 8
    assert sum(len(r.ids) for r in matrix.select("ids").collect()) == 200


def test_draw_follows_the_target(spark):
    """Documents of the target's words are drawn before others; the draw has the stated size."""
    docs = [(k, ("alpha beta " if k % 4 == 0 else "gamma delta ") * 20) for k in range(800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("theirs")).withColumn("rank", F.lit(None).cast("int"))
    target = spark.createDataFrame([("alpha beta " * 50,)], "text string")
    drawn = resampling.resample(frame, target)
    assert drawn.columns == frame.columns and drawn.count() == 80
    assert drawn.where(F.col("doc_id") % 4 == 0).count() > 75


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert resampling.importance_ranks(none, some).count() == 0
    got = resampling.importance_ranks(some, none, buckets=50).collect()
    assert sorted(map(tuple, got), key=str) == brute([(1, "a " * 30), (2, None)], [], 50)
    assert resampling.resample(none, some).count() == 0
