"""Gradient boosting of all walk-forward folds in shared passes, on histograms that add up across tasks.

Features are cut into bins once, at quantiles of the first training rows of a key,
which every fold may see, and rows are packed once into blocks of bin codes. A
level of the trees of all folds is one pass over the blocks: a task adds up each
fold's gradients, curvatures and counts by node, feature and bin over its own
rows (those of a fold are the first ones of a block), and only these histograms
meet, by key and fold. No row is copied into folds, and no group holds a fold's
rows. ``together`` trees are grown in one job; then the models are written, and
the blocks are written again with the scores so far, so that a pass walks through
at most that many trees and lost work goes back no further.

Gradients are summed as whole numbers of 2^-32: sums are exact, and a tree
depends neither on the order of addition nor on blocks and partitions (for up
to 2^31 rows of a key).

Splits are those of ``models.Boosting`` restricted to bins: the largest gain in
squared error, of equals the first feature and then the lowest bin; leaves are
Newton steps. A node that no split improves keeps its rows in one leaf.

Defined cases: a key too short for a fold gives no row; a fold whose training
rows have one class predicts that class, one without training rows 0.5; null
keys are a key; null targets and features must be dropped before; an empty
frame gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks, shared_folds
from tidemark.operators.models import MIN_TRAIN, TEST
from tidemark.operators.regimes import _keys_schema
from tidemark.sources import store

BINS, SCALE = 64, float(1 << 32)
#: Numbers of histograms that a task holds before it passes them on.
HELD = 1 << 22
#: Models of all keys and folds are broadcast up to this size, and shuffled to the blocks beyond it.
BROADCAST_BYTES = 32 << 20


def cut_points(rows: DataFrame, width: int, bins: int, by: Sequence[str], most: int) -> DataFrame:
    """keys, edges: inner bin edges of each feature, quantiles of the rows in the key's earliest fold.

    Edges are exact while those rows number no more than half of the sketch's
    accuracy, which is the larger of 10,000 and twice ``most``, a million at most.
    """
    accuracy = min(max(10_000, 2 * most), 1_000_000)
    points = [k / bins for k in range(1, bins)]
    early = ts.with_group_facts(rows, by, _low=F.min("first")).where("first = _low")
    return early.groupBy(*by).agg(F.array(*[F.percentile_approx(F.col("x")[k], points, accuracy) for k in range(width)]).alias("edges"))


def codes_of(x: np.ndarray, edges) -> np.ndarray:
    """Bins of the rows of x: how many of a feature's edges lie below the value."""
    return np.column_stack([np.searchsorted(np.asarray(e, float), x[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8)


def _with(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """``rows`` with the other columns of ``facts``; null keys are equal."""
    facts = facts.select(*blocks._keyed(keys), *[c for c in facts.columns if c not in keys])
    return blocks._attached(rows, F.broadcast(facts) if broadcast else facts, keys, how)


class Trees:
    """Complete trees of one depth as flat numbers: split features, split bins, leaf values, nodes level by level."""

    def __init__(self, depth: int):
        self.depth, self.inner = depth, (1 << depth) - 1
        self.width = 2 * self.inner + (1 << depth)

    def nodes(self, tree: np.ndarray, codes: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node within a level."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for level in range(levels):
            at = (1 << level) - 1 + node
            node = 2 * node + (codes[rows, tree[at].astype(np.int64)] > tree[self.inner + at])
        return node

    def values(self, tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return tree[2 * self.inner + self.nodes(tree, codes, self.depth)]

    def grown(self, tree: np.ndarray, level: int, sums: np.ndarray, bins: int) -> np.ndarray:
        """The tree with a level's splits, after its last level with leaves, from sums by (gradient, curvature, count), node, feature and bin."""
        tree, nodes = tree.copy(), 1 << level
        g, h, n = np.cumsum(sums, axis=-1).astype(float)
        rest = n[..., -1:] - n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (g / n - (g[..., -1:] - g) / rest) ** 2 * n * rest
        gain = np.where((n > 0) & (rest > 0), gain, -1.0).reshape(nodes, -1)
        best, every = gain.argmax(axis=1), np.arange(nodes)
        splits = gain[every, best] > 0
        # Without a split all rows go left.
        feature, at = np.where(splits, best // bins, 0), np.where(splits, best % bins, bins - 1)
        tree[nodes - 1 : 2 * nodes - 1] = feature
        tree[self.inner + nodes - 1 : self.inner + 2 * nodes - 1] = at
        if level == self.depth - 1:
            gl, hl = (v[every, feature, at] for v in (g, h))
            gt, ht = (v[every, feature, -1] for v in (g, h))
            least = 1e-12 * SCALE
            tree[2 * self.inner :: 2] = gl / np.maximum(hl, least)
            tree[2 * self.inner + 1 :: 2] = (gt - gl) / np.maximum(ht - hl, least)
        return tree


def fold_totals(trains: DataFrame, by: Sequence[str]) -> DataFrame:
    """keys, fold, n, positives of each fold's training rows, from running sums over the chunks between two folds' starts."""
    chunks = trains.groupBy(*by, F.col("first").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"))
    grid = trains.groupBy(*by).agg(F.max("folds").alias("_f")).select(*by, F.explode(F.sequence(F.lit(0), F.col("_f") - 1)).alias("fold"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("positives"))
    every = chunks.unionByName(grid).groupBy(*by, "fold").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    before = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return every.select(*by, "fold", F.sum("n").over(before).alias("n"), F.sum("positives").over(before).alias("positives"))


def fit_folds(
    frame: DataFrame, features: Sequence[str], trees: int = 80, rate: float = 0.04, depth: int = 2, bins: int = BINS, min_train: int = MIN_TRAIN, test: int = TEST, embargo: int = 0,
    by: Sequence[str] = ts.KEYS, order: str = "date", block_rows: int = shared_folds.BLOCK_ROWS, together: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(rows with their own test fold and its number ``folds``, model of each key and fold: n, positives, edges, base, trees; the last two null where training rows have not both classes)."""
    if not 2 <= bins <= 256 or depth < 1:
        raise ValueError("from 2 to 256 bins and a depth of 1 or more")
    by, width, plan = list(by), len(features), Trees(depth)
    rows = shared_folds.rows_of_folds(frame, features, min_train, test, embargo, by, order, block_rows)
    trains = rows.where("first < folds")
    totals = store.written(fold_totals(trains, by), "fold-totals")
    edges = store.written(cut_points(trains, width, bins, by, min_train), "fold-edges")
    keys = _keys_schema(rows, by)
    blank = F.array(*[F.lit(0.0)] * plan.width)

    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("positives") / F.col("n")))
    begun = totals.where("positives > 0 and positives < n").select(*by, "fold", F.log(share / (1 - share)).alias("base"))
    n_models = begun.count()
    small = n_models * plan.width * (together + 1) * 8 <= BROADCAST_BYTES

    def coded(batches):
        for batch in batches:
            out = batch[[*by, "first", "target"]].copy()
            out["codes"] = [codes_of(np.asarray(x, float).reshape(-1, width), e).tobytes() for x, e in zip(batch["x"], batch["edges"], strict=True)]
            out["score"] = None
            yield out

    block_schema = f"{keys}, `first` array<int>, target array<int>, codes binary, score array<double>"
    place = store.new_path(rows.sparkSession, "fold-codes")
    _with(shared_folds.packed_blocks(trains, by), edges, by).mapInPandas(coded, block_schema).write.parquet(place)

    def with_models(packed: DataFrame, model: DataFrame) -> DataFrame:
        """Blocks with the arrays fold, base and trees of their key's models, by fold."""
        met = model.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("fold", "base", "trees"))).alias("_m"))
        met = met.select(*by, *[F.col(f"_m.{c}").alias(c) for c in ("fold", "base", "trees")])
        return _with(packed, met, by, broadcast=small).select(*by, "first", "target", "codes", "score", "fold", "base", "trees")

    def scored(r, finished: int):
        """(fold, base, trees, rows, codes, score) of each fold that has rows in the block, with ``finished`` trees since the block was written in the score."""
        first, target, codes, score, folds, bases, forests = r[len(by) :]
        codes, at = np.frombuffer(codes, np.uint8).reshape(-1, width), 0
        ends = np.searchsorted(np.asarray(first), np.asarray(folds), "right")
        for fold, base, forest, m in zip(folds, bases, forests, ends.tolist(), strict=True):
            if m:
                now = np.full(m, base) if score is None else np.array(score[at : at + m], float)
                at += m
                forest = np.asarray(forest, float).reshape(-1, plan.width)
                for tree in forest[:finished]:
                    now += rate * plan.values(tree, codes[:m])
                yield fold, base, forest, codes[:m], np.asarray(target[:m], float), now

    def histograms(finished: int, level: int):
        size = (1 << level) * width * bins

        def shown(sums) -> pd.DataFrame:
            out = pd.DataFrame([k for k in sums], columns=[*by, "fold"])
            return out.assign(base=[b for b, _, _ in sums.values()], trees=[t.ravel() for _, t, _ in sums.values()], sums=[s.ravel() for _, _, s in sums.values()])

        def run(batches):
            sums: dict[tuple, tuple] = {}
            for batch in batches:
                for r in batch.itertuples(index=False, name=None):
                    key = tuple(None if pd.isna(v) else v for v in r[: len(by)])
                    for fold, base, forest, codes, y, score in scored(r, finished):
                        _, _, total = sums.setdefault((*key, fold), (base, forest, np.zeros((3, size), np.int64)))
                        p = 1 / (1 + np.exp(-score))
                        node = plan.nodes(forest[finished], codes, level)
                        cell = ((node[:, None] * width + np.arange(width)) * bins + codes).ravel()
                        for k, v in enumerate((np.rint((y - p) * SCALE), np.rint(p * (1 - p) * SCALE))):
                            # Doubles add whole numbers below 2^53 exactly, and a block has far fewer than 2^21 rows.
                            total[k] += np.bincount(cell, np.repeat(v, width), size).astype(np.int64)
                        total[2] += np.bincount(cell, minlength=size)
                    if sum(s.size for _, _, s in sums.values()) > HELD:
                        yield shown(sums)
                        sums.clear()
            if sums:
                yield shown(sums)

        return run

    model_schema = f"{keys}, fold int, base double, trees array<double>"

    def grow(finished: int, level: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            out = part[[*by, "fold", "base"]].iloc[:1].copy()
            total = np.sum(np.stack(part["sums"].to_list()), axis=0).reshape(3, 1 << level, width, bins)
            forest = np.array(part["trees"].iloc[0], float).reshape(-1, plan.width)
            forest[finished] = plan.grown(forest[finished], level, total, bins)
            if level == depth - 1:
                forest = np.vstack((forest, np.zeros(plan.width)))
            out["trees"] = [forest.ravel()]
            return out

        return run

    def moved(finished: int):
        def run(batches):
            for batch in batches:
                out = batch[[*by, "first", "target", "codes"]].copy()
                out["score"] = [np.concatenate([s for *_, s in scored(r, finished)] or [np.zeros(0)]) for r in batch.itertuples(index=False, name=None)]
                yield out

        return run

    spark = rows.sparkSession
    read = lambda path: spark.read.schema(block_schema).parquet(path)
    forest = store.new_path(spark, "fold-trees")
    begun.select(*by, "fold", "base", F.array().cast("array<double>").alias("trees")).write.parquet(f"{forest}/part=-1")
    for part, done in enumerate(range(0, trees if n_models else 0, together)):
        many = min(together, trees - done)
        model, packed = begun.select(*by, "fold", "base", blank.alias("trees")), read(place)
        for finished in range(many):
            for level in range(depth):
                found = with_models(packed, model).mapInPandas(histograms(finished, level), f"{model_schema}, sums array<bigint>")
                model = found.groupBy(*by, "fold").applyInPandas(grow(finished, level), model_schema)
        model.withColumn("trees", F.slice("trees", 1, many * plan.width)).write.parquet(f"{forest}/part={part}")
        if done + many < trees:
            now, before = store.new_path(spark, "fold-codes"), place
            made = spark.read.schema(model_schema).parquet(f"{forest}/part={part}")
            with_models(packed, made).mapInPandas(moved(many), block_schema).write.parquet(now)
            place = now
            store.delete(before)
    store.delete(place)
    grown = spark.read.schema(f"{model_schema}, part int").parquet(forest)
    whole = F.flatten(F.sort_array(F.collect_list(F.struct("part", "trees")))["trees"])
    grown = grown.groupBy(*by, "fold").agg(F.max("base").alias("base"), whole.alias("trees"))
    return rows, _with(_with(totals, edges, by), grown, [*by, "fold"], "left")


def walk_forward_predictions(
    frame: DataFrame, features: Sequence[str], trees: int = 80, rate: float = 0.04, depth: int = 2, bins: int = BINS, min_train: int = MIN_TRAIN, test: int = TEST, embargo: int = 0,
    by: Sequence[str] = ts.KEYS, order: str = "date", block_rows: int = shared_folds.BLOCK_ROWS, together: int = 8,
) -> DataFrame:
    """keys, order, fold, next_return, target, probability of all test rows. A group holds the ``test`` rows of a fold."""
    by, plan = list(by), Trees(depth)
    rows, model = fit_folds(frame, features, trees, rate, depth, bins, min_train, test, embargo, by, order, block_rows, together)
    model = store.written(model, "fold-models")
    kept = [*by, order, "fold", "next_return", "target"]

    def one(ahead: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = ahead[kept].copy()
        m = of.iloc[0] if len(of) else None
        if m is None or m["trees"] is None:
            out["probability"] = 0.5 if m is None or m["n"] == 0 else m["positives"] / m["n"]
            return out
        codes = codes_of(np.array(ahead["x"].to_list(), float), m["edges"])
        score = np.full(len(codes), m["base"])
        for tree in np.asarray(m["trees"], float).reshape(-1, plan.width):
            score += rate * plan.values(tree, codes)
        out["probability"] = 1 / (1 + np.exp(-score))
        return out

    tests = rows.where("fold >= 0 and fold < folds").select(*kept, "x")
    schema = f"{_keys_schema(rows, by, order)}, fold int, next_return double, target int, probability double"
    return tests.groupBy(*by, "fold").cogroup(model.groupBy(*by, "fold")).applyInPandas(one, schema)
