"""Mixing: sizes and targets against plain loops, and what dependent rounding must keep."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

ROWS = "doc_id long, text string, source string"


def plain_targets(sizes, weights, most):
    """Sources in order, capped one round after the other."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def corpus(n, seed, sources=("b", "a", "é", None, "", "tiny")):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        s = sources[0] if k % 3 == 0 else sources[int(rng.integers(0, len(sources) - 1))]
        rows.append((k, " ".join(["w"] * int(rng.integers(0, 60) if k % 40 else 900)), s))
    return [*rows, (n, "one two\tthree four\x0bfive", "tiny"), (n + 1, None, "tiny"), (None, " \n ", "none"), (5, "again again", "a"), (5, "again again", "a")]


def test_sizes_and_targets(spark):
    rows = corpus(400, 1)
    got = mixing.copies(spark.createDataFrame(rows, ROWS)).collect()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    wanted = plain_targets(sizes, (1, 2, 3), 3)
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    assert wanted["tiny"] == 3 * sizes["tiny"]  # a cap that binds
    assert len(got) == len(rows)
    of = {}
    for k, t, s in rows:
        of.setdefault(k, []).append((words(t), s))
    for r in got:
        assert any(r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s]) for n, s in of[r["doc_id"]])


@pytest.mark.parametrize("block_rows", [2, 5, 64, 4096])
def test_sources_meet_their_targets(spark, block_rows):
    """In one block, and over up to nine levels of blocks."""
    frame = spark.createDataFrame(corpus(400, 2), ROWS)
    made = mixing.copies(frame, block_rows=block_rows)
    rows = made.collect()
    assert len(rows) == frame.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in rows)
    by = {}
    for r in rows:  # whole copies below and above the rate only
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        if r["size"]:
            rate = r["target"] / r["source_size"]
            assert r["copies"] in (np.floor(rate + 1e-12), np.ceil(rate - 1e-12))
    for (_, target), own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.copies(frame.repartition(7), block_rows=block_rows).collect()))


def test_few_documents_come_near_too(spark):
    """Forty documents a source, one of them with a third of its words."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(4000 if k < 5 else rng.integers(50, 400))), f"s{k % 5}") for k in range(200)]
    taken, target = {}, {}
    for r in mixing.copies(spark.createDataFrame(rows, ROWS)).collect():
        taken[r.doc_id % 5] = taken.get(r.doc_id % 5, 0) + r.taken
        target[r.doc_id % 5] = r.target
    assert max(abs(taken[k] - target[k]) / target[k] for k in range(5)) <= 0.1  # half of the large document is 0.29 of a target


def test_expectations_are_kept():
    """Over many draws each document's mean share is its own, and the words of all are fixed but for one document."""
    rng = np.random.default_rng(3)
    mass, share = np.array([9.0, 5, 5, 3, 2, 1, 1, 1]), np.array([0.3, 0.7, 0.5, 0.2, 0.9, 0.5, 0.25, 0.6])
    made = np.array([mixing.pivot(mass, share, rng.random(8)) for _ in range(20_000)])
    assert np.abs(made.mean(axis=0) - share).max() < 0.015
    assert np.abs(made @ mass - share @ mass).max() < 1e-9
    assert (((made > 0) & (made < 1)).sum(axis=1) <= 1).all()


def test_repeat_takes_the_copies(spark):
    frame = spark.createDataFrame([(k, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(60)], ROWS).withColumn("copies", F.lit("theirs"))
    plan = mixing.copies(frame)
    out = mixing.repeat(frame, plan)
    assert out.columns == frame.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["copies"] for r in plan.where("copies > 0").collect()}
    with pytest.raises(Exception, match="several rows"):
        mixing.repeat(frame.union(frame), mixing.copies(frame.union(frame))).count()


def test_odd_tables(spark):
    assert mixing.copies(spark.createDataFrame([], ROWS)).count() == 0
    empty = mixing.copies(spark.createDataFrame([(1, None, "a"), (2, "", None)], ROWS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
    one = mixing.copies(spark.createDataFrame([(1, "a b c", None)], ROWS)).collect()
    assert [(r["target"], r["taken"]) for r in one] == [(3.0, 3)]
