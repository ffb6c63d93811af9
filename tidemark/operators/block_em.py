"""Hidden Markov fits of series longer than a task: the E-step as an associative scan over blocks.

The forward and the backward recursion of a chain are products of K x K matrices.
Each block of a series is reduced to one scaled product; from those, one for
each block, every block gets the forward state before it and the backward vector
after it; and each block then gives its sums for the M-step. A round of EM is one
job over the packed blocks, and what meets by key is a few numbers for each block.
Series run side by side, each until its own likelihood settles.

The fit is that of ``regimes.fit_hmm``, to rounding.

Defined cases: rows without a value are left out; a series of fewer than twice as
many rows as states is an error; an empty frame gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks
from tidemark.operators.regimes import FLOOR, _keys_schema, _prefix_products, block_product, densities
from tidemark.sources import store

ROUNDS, TOLERANCE = 200, 1e-4
_MODEL = "start array<double>, transition array<double>, means array<double>, stds array<double>, floor double, last double, settled boolean"
_SUMS = "weight array<double>, first array<double>, second array<double>, moves array<double>, begin array<double>, log_like double"


def _begin(rows: DataFrame, r: str, n_states: int, seed: int, by: list[str], block_rows: int) -> DataFrame:
    """The first model of each key: states by bands of smoothed absolute deviation."""
    rows = ts.with_group_facts(rows, by, _mean=F.avg(r), _std=F.stddev_pop(r), _n=F.count(r)).withColumn("_dev", F.abs(F.col(r) - F.col("_mean")))
    rows = store.written(rows, "deviations")
    near = Window.partitionBy(*by, blocks.BLOCK).orderBy(blocks.POS).rowsBetween(-4, 4)
    smoothed = blocks.with_halo(rows, 4, 4, block_rows).withColumn("_dev", F.avg("_dev").over(near)).where(blocks.OWN)
    edges = blocks.percentiles(rows, "_dev", [k / n_states for k in range(1, n_states)], by, [blocks.POS]) if n_states > 1 else rows.select(*by, F.array().cast("array<double>").alias("q")).distinct()
    banded = smoothed.join(edges, by).withColumn("_band", F.size(F.filter("q", lambda e: e < F.col("_dev"))))
    stats = banded.groupBy(*by, "_mean", "_std", "_n", "_band").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("m"), F.stddev_pop(r).alias("s"))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        mean, std, n = (float(part[c].iloc[0]) for c in ("_mean", "_std", "_n"))
        if n < 2 * n_states:
            raise ValueError("too few returns for this number of states")
        floor = max(std * 1e-3, 1e-12)
        found = {int(b): (int(k), float(m), float(s)) for b, k, m, s in part[["_band", "n", "m", "s"]].itertuples(index=False)}
        means = np.array([found[k][1] if k in found else mean for k in range(n_states)]) + np.random.default_rng(seed).normal(0, 1e-3, n_states) * std
        stds = np.array([max(found[k][2], floor) if found.get(k, (0,))[0] > 1 else std + floor for k in range(n_states)])
        transition = np.full((n_states, n_states), 0.1 / max(1, n_states - 1))
        np.fill_diagonal(transition, 0.9 if n_states > 1 else 1.0)
        return part[by].iloc[:1].assign(start=[np.full(n_states, 1 / n_states)], transition=[transition.ravel()], means=[means], stds=[stds], floor=floor, last=-np.inf, settled=False)

    return stats.groupBy(*by).applyInPandas(first, f"{_keys_schema(stats, by)}, {_MODEL}")


def _steps(row, k: int) -> np.ndarray:
    """The matrices of a block's rows: transition times likelihoods; those of the series' first row are the likelihoods alone."""
    like = np.maximum(densities(np.asarray(row.r, float), np.asarray(row.means), np.asarray(row.stds)), FLOOR)
    out = np.reshape(row.transition, (k, k))[None] * like[:, None, :]
    if getattr(row, "block") == 0:
        out[0] = np.diag(like[0])
    return out


def _block_sums(row, k: int) -> tuple:
    steps, before, after = _steps(row, k), np.asarray(row.before, float), np.asarray(row.after, float)
    r, n = np.asarray(row.r, float), len(row.r)
    forward = before @ _prefix_products(steps)
    forward /= np.maximum(forward.sum(axis=1, keepdims=True), FLOOR)
    behind = _prefix_products(steps[1:][::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1) @ after if n > 1 else np.zeros((0, k))
    backward = np.vstack((behind, after))
    backward /= np.maximum(backward.sum(axis=1, keepdims=True), FLOOR)
    posterior = forward * backward
    posterior /= posterior.sum(axis=1, keepdims=True)
    previous = np.vstack((before, forward[:-1]))
    pair = previous[:, :, None] * steps * backward[:, None, :]
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), FLOOR)
    total = np.log(np.maximum((previous[:, None, :] @ steps)[:, 0].sum(axis=1), FLOOR)).sum()
    gap = r[:, None] - np.asarray(row.means)
    begin = posterior[0] if row.block == 0 else np.zeros(k)
    moves = pair[1:] if row.block == 0 else pair
    return posterior.sum(axis=0), posterior.T @ r, (posterior * gap * gap).sum(axis=0), moves.sum(axis=0).ravel(), begin, float(total)


def fit(df: DataFrame, n_states: int = 3, seed: int = 0, r: str = "return", by: Sequence[str] = ts.KEYS, order: str = "date", block_rows: int = blocks.BLOCK_ROWS, rounds: int = ROUNDS, tol: float = TOLERANCE) -> DataFrame:
    """keys, start, transition (row after row), means, stds, last (log-likelihood): states by ascending mean."""
    by, k = list(by), n_states
    block_rows = max(block_rows, 4)
    some = df.where(F.col(r).isNotNull()).select(*by, order, F.col(r).cast("double").alias("r"))
    rows = store.written(blocks.in_blocks(blocks.positioned(some, by, [order]), block_rows).select(*by, blocks.POS, blocks.BLOCK, "r"), "em-rows")
    cells = F.sort_array(F.collect_list(F.struct(blocks.POS, "r")))
    packed = store.written(rows.groupBy(*by, F.col(blocks.BLOCK).alias("block")).agg(cells.alias("_c")).select(*by, "block", F.col("_c.r").alias("r")), "em-blocks")
    model = store.written(_begin(rows, "r", k, seed, by, block_rows), "em-models")
    keys = _keys_schema(rows, by)

    def products(batches):
        for batch in batches:
            yield batch[[*by, "block"]].assign(product=[block_product(_steps(x, k).transpose(0, 2, 1)).T.ravel() for x in batch.itertuples(index=False)])

    def carries(part: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame(columns=[*by, "block", "before", "after"])
        part = part.sort_values("block")
        matrices = [np.reshape(m, (k, k)) for m in part["product"]]
        before, after = [np.asarray(now["start"].iloc[0], float)], [np.ones(k)]
        for m in matrices[:-1]:
            v = before[-1] @ m
            before.append(v / max(float(v.sum()), FLOOR))
        for m in matrices[:0:-1]:
            v = m @ after[-1]
            after.append(v / max(float(v.sum()), FLOOR))
        return part[[*by, "block"]].assign(before=before, after=after[::-1])

    def sums(batches):
        for batch in batches:
            found = [_block_sums(x, k) for x in batch.itertuples(index=False)]
            yield batch[by].assign(**dict(zip([c.split()[0] for c in _SUMS.split(", ")], map(list, zip(*found, strict=True)), strict=True)))

    def maximise(part: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return now
        w, s1, s2, moves, begin = (np.sum(np.stack(part[c].to_list()), axis=0) for c in ("weight", "first", "second", "moves", "begin"))
        total, last, w = float(part["log_like"].sum()), float(now["last"].iloc[0]), w + 1e-12
        means = s1 / w
        gap = means - np.asarray(now["means"].iloc[0])
        # Squares were summed about the old means: about the new ones they are less by this.
        stds = np.maximum(np.sqrt(np.maximum(s2 / w - gap * gap, 0.0)), float(now["floor"].iloc[0]))
        moves = moves.reshape(k, k) + 1e-6
        settled = bool(total - last < tol * max(1.0, abs(total)) * 1e-2)
        return now[by].assign(start=[begin], transition=[(moves / moves.sum(axis=1, keepdims=True)).ravel()], means=[means], stds=[stds], floor=now["floor"], last=last if settled else total, settled=settled)

    for _ in range(rounds):
        # Settled series take no part: their model is passed on as it is.
        busy = packed.join(model.where("not settled"), by)
        made = busy.mapInPandas(products, f"{keys}, block long, product array<double>")
        ends = made.groupBy(*by).cogroup(model.where("not settled").groupBy(*by)).applyInPandas(carries, f"{keys}, block long, before array<double>, after array<double>")
        totals = busy.join(ends, [*by, "block"]).mapInPandas(sums, f"{keys}, {_SUMS}")
        model = store.written(totals.groupBy(*by).cogroup(model.groupBy(*by)).applyInPandas(maximise, f"{keys}, {_MODEL}"), "em-models")
        if model.where("not settled").isEmpty():
            break

    def ordered(batches):
        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("start", "transition", "means", "stds")}
            for row in batch.itertuples(index=False):
                at = np.argsort(np.asarray(row.means))
                made["transition"].append(np.reshape(row.transition, (k, k))[np.ix_(at, at)].ravel())
                for c in ("start", "means", "stds"):
                    made[c].append(np.asarray(getattr(row, c))[at])
            yield batch.assign(**{c: pd.Series(v, index=batch.index, dtype=object) for c, v in made.items()})

    return model.drop("floor", "settled").mapInPandas(ordered, f"{keys}, {', '.join(x for x in _MODEL.split(', ') if x.split()[0] not in ('floor', 'settled'))}")
