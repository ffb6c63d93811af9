"""Logistic models of all walk-forward folds in shared passes over the rows.

Expanding folds overlap: a row trains in every fold from some first one on. Rows
are not copied into folds here. They are packed once into blocks; a Newton step
of all folds is one pass over the blocks, in which a task adds up the gradient
and Hessian of each fold over its own rows (those of a fold are the first ones of a
block), and only those sums meet by key. Means and deviations of folds are
running merges of the chunks between two folds' ends. Shuffled rows are linear in
the rows of the frame, and a step shuffles (tasks * folds) sums.

The result is that of ``models.walk_forward_predictions`` with ``models.Logistic``.

Defined cases: a key too short for a fold gives no row; a fold whose training
rows have one class predicts that class; null targets and features must be
dropped before; an empty frame gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks
from tidemark.operators.models import MIN_TRAIN, TEST
from tidemark.operators.regimes import _keys_schema
from tidemark.sources import store

BLOCK_ROWS, CLIP, SETTLED = 4096, 35.0, 1e-10
#: Numbers of Hessians that a task holds before it passes its sums on.
HELD = 1 << 22
_MODEL = "w array<array<double>>, mean array<array<double>>, std array<array<double>>, positives array<double>, n array<double>, step double"


def _merged(frame: pd.DataFrame, n_folds: int) -> tuple[np.ndarray, ...]:
    """(n, positives, means, deviations) of each fold's training rows, from the chunks' own in order."""
    width = len(frame["m"].iloc[0])
    n = positives = 0.0
    mean, square = np.zeros(width), np.zeros(width)
    chunks = {int(r.first): r for r in frame.itertuples()}
    out: list[tuple] = []
    for fold in range(n_folds):
        if (c := chunks.get(fold)) is not None:
            more, m = float(c.n), np.asarray(c.m, float)
            gap = m - mean
            square = square + np.asarray(c.v, float) * more + gap * gap * n * more / (n + more)
            mean, n, positives = mean + gap * more / (n + more), n + more, positives + float(c.positives)
        std = np.sqrt(square / max(n, 1.0))
        out.append((n, positives, mean, np.where(std > 1e-15 * np.abs(mean), std, 1.0)))
    return tuple(np.array(x) for x in zip(*out, strict=True))


def rows_of_folds(frame: DataFrame, features: Sequence[str], min_train: int, test: int, embargo: int, by: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """The rows of keys that have a fold, once each and written: keys, order, next_return, target, position and block, number of ``folds``, the ``first`` fold that the row trains, the ``fold`` that it tests, x."""
    by = list(by)
    placed = blocks.positioned(frame.select(*by, order, *features, "target", "next_return"), by, [order])
    placed = ts.with_group_facts(placed, by, _n=F.count(F.lit(1))).where(F.col("_n") - test > min_train)
    folds = F.floor((F.col("_n") - test - 1 - min_train) / test).cast("int") + 1
    first = F.greatest(F.lit(0), F.floor((F.col(blocks.POS) + embargo - min_train) / test).cast("int") + 1)
    own = F.floor((F.col(blocks.POS) - min_train) / test).cast("int")
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = placed.select(*by, order, "next_return", F.col("target").cast("int").alias("target"), blocks.POS, folds.alias("folds"), first.alias("first"), own.alias("fold"), x.alias("x"))
    return store.written(blocks.in_blocks(rows, block_rows), "fold-rows")


def packed_blocks(trains: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each block of training rows, in order of position: keys, first, target, x (flat)."""
    cells = F.sort_array(F.collect_list(F.struct(blocks.POS, "first", "target", "x")))
    packed = trains.groupBy(*by, blocks.BLOCK).agg(cells.alias("_c"))
    return packed.select(*by, F.col("_c.first").alias("first"), F.col("_c.target").alias("target"), F.flatten("_c.x").alias("x"))


def fit_folds(
    frame: DataFrame, features: Sequence[str], C: float = 0.3, rounds: int = 60, min_train: int = MIN_TRAIN, test: int = TEST, embargo: int = 0,
    by: Sequence[str] = ts.KEYS, order: str = "date", block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(rows with their own test fold and its number ``folds``, model of each key: w, mean, std, positives, n, an entry for each fold)."""
    by = list(by)
    rows = rows_of_folds(frame, features, min_train, test, embargo, by, order, block_rows)

    trains = rows.where("first < folds")
    packed = store.written(packed_blocks(trains, by), "fold-blocks")

    stats = [F.array(*[f(F.col("x")[k]) for k in range(len(features))]).alias(a) for f, a in ((F.avg, "m"), (F.var_pop, "v"))]
    chunks = trains.groupBy(*by, "folds", "first").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"), *stats)
    keys, width = _keys_schema(rows, by), len(features) + 1

    def begin(part: pd.DataFrame) -> pd.DataFrame:
        n, positives, mean, std = _merged(part, int(part["folds"].iloc[0]))
        out = part[by].iloc[:1].copy()
        for c, v in (("w", np.zeros((len(n), width))), ("mean", mean), ("std", std)):
            out[c] = [[list(r) for r in v]]
        out["positives"], out["n"], out["step"] = [positives], [n], np.inf
        return out

    model = store.written(chunks.groupBy(*by).applyInPandas(begin, f"{keys}, {_MODEL}"), "fold-models")

    def shown(sums) -> pd.DataFrame:
        out = pd.DataFrame(list(sums), columns=by)
        return out.assign(grad=[list(g.ravel()) for g, _ in sums.values()], hess=[list(h.ravel()) for _, h in sums.values()])

    def partial(batches):
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                key = tuple(getattr(r, c) for c in by)
                w, mean, std = (np.stack(v) for v in (r.w, r.mean, r.std))
                grad, hess = sums.setdefault(key, (np.zeros(w.shape), np.zeros((*w.shape, width))))
                x, y = np.asarray(r.x).reshape(-1, width - 1), np.asarray(r.target, float)
                ends = np.searchsorted(np.asarray(r.first), np.arange(len(w)), "right")
                for fold in np.flatnonzero(ends):
                    m = ends[fold]
                    a = np.column_stack((np.ones(m), (x[:m] - mean[fold]) / std[fold]))
                    p = 1 / (1 + np.exp(-np.clip(a @ w[fold], -CLIP, CLIP)))
                    grad[fold] += a.T @ (p - y[:m])
                    hess[fold] += (a * (p * (1 - p))[:, None]).T @ a
                if sum(h.size for _, h in sums.values()) > HELD:
                    yield shown(sums)
                    sums.clear()
        if sums:
            yield shown(sums)

    ridge = np.append(0.0, np.ones(width - 1))

    def step(keys_of: tuple, sums: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        out = now.copy()
        w = np.stack(now["w"].iloc[0])
        grad = np.sum(np.stack(sums["grad"].to_list()), axis=0).reshape(w.shape)
        hess = np.sum(np.stack(sums["hess"].to_list()), axis=0).reshape((*w.shape, width))
        move = np.linalg.solve(C * hess + np.diag(ridge + 1e-10), (C * grad + ridge * w)[..., None])[..., 0]
        one_class = (now["positives"].iloc[0] == 0) | (now["positives"].iloc[0] == now["n"].iloc[0])
        size = np.where(one_class, 0.0, np.abs(move).max(axis=1))
        w = w - np.where(size > SETTLED * 1e-3, 1.0, 0.0)[:, None] * move / np.maximum(1.0, size)[:, None]
        out["w"], out["step"] = [[list(r) for r in w]], float(size.max())
        return out

    for _ in range(rounds):
        found = packed.join(model, by).mapInPandas(partial, f"{keys}, grad array<double>, hess array<double>")
        model = store.written(found.groupBy(*by).cogroup(model.groupBy(*by)).applyInPandas(step, f"{keys}, {_MODEL}"), "fold-models")
        # One number a step; null where there is no key.
        if (model.agg(F.max("step")).first()[0] or 0.0) < SETTLED:
            break
    return rows, model


def walk_forward_predictions(frame: DataFrame, features: Sequence[str], C: float = 0.3, min_train: int = MIN_TRAIN, test: int = TEST, embargo: int = 0, by: Sequence[str] = ts.KEYS, order: str = "date", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, order, fold, next_return, target, probability of all test rows."""
    rows, model = fit_folds(frame, features, C, 60, min_train, test, embargo, by, order, block_rows)
    tests = rows.where("fold >= 0 and fold < folds").join(model, list(by))
    of_fold = lambda c: F.element_at(c, F.col("fold") + 1)
    scaled = F.zip_with(F.zip_with("x", of_fold("mean"), lambda a, m: a - m), of_fold("std"), lambda d, s: d / s)
    z = of_fold("w")[0] + F.aggregate(F.zip_with(scaled, F.slice(of_fold("w"), 2, len(features)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))))
    positives, n = of_fold("positives"), of_fold("n")
    one_class = F.when(n == 0, F.lit(0.5)).when((positives == 0) | (positives == n), positives / n)
    return tests.select(*by, order, "fold", "next_return", "target", F.coalesce(one_class, p).alias("probability"))
