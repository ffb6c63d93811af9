"""Moments, the stationary bootstrap and multiple-testing adjustment."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normal, ts
from tidemark.operators import blocks
from tidemark.operators.evaluate import PERIODS
from tidemark.sources import store

EULER_GAMMA = 0.5772156649


def moments(df: DataFrame, r: str, by=ts.KEYS) -> DataFrame:
    """n, mean, std (sample), skew and excess kurtosis, both corrected for bias."""
    base = df.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("_g1"), F.kurtosis(r).alias("_g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return base.select(*by, "n", "mean", "std", ts.no_nan(skew).alias("skew"), ts.no_nan(kurt).alias("kurtosis"))


def resample_index(df: DataFrame, replicates: int, mean_block: float, seed: int, by=ts.KEYS) -> DataFrame:
    """keys, replicate, i, source: stationary-bootstrap positions. ``df`` has keys and n.

    A block starts at i = 0 and then with probability 1 / mean_block; its start is
    uniform, and positions run on from it around the end. Draws are hashes of seed,
    key, replicate and i, so the result does not depend on partitions.
    """
    grid = df.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).where("n > 0")
    # Replicates are dealt out before they are multiplied into rows.
    grid = grid.repartition(*by, "replicate").select(*by, "n", "replicate", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    key = [*by, "replicate", "i"]
    starts = (F.col("i") == 0) | (ts.uniform(0, seed, *key) < 1.0 / mean_block)
    w = Window.partitionBy(*by, "replicate").orderBy("i")
    start = F.when(starts, F.struct(F.floor(ts.uniform(1, seed, *key) * F.col("n")).alias("at"), F.col("i").alias("i")))
    last = F.last(start, ignorenulls=True).over(w)
    return grid.select(*by, "n", "replicate", "i", last.alias("_b")).select(*by, "replicate", "i", F.pmod(F.col("_b.at") + F.col("i") - F.col("_b.i"), F.col("n")).cast("int").alias("source"))


def bootstrap_samples(df: DataFrame, r: str, statistic: Callable[[str], Column] | Callable[[np.ndarray], float], replicates: int, mean_block: float, seed: int, native: bool = True, by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, replicate, value: a statistic of each resampled series.

    ``statistic``: an aggregate of a column name (native), or a function of a
    numpy array in resampled order (run in grouped pandas functions).
    """
    some = df.where(F.col(r).isNotNull()).select(*by, order, F.col(r).alias("_r"))
    placed = some.select(*by, "_r", ts.row_index(by, order).alias("source"))
    counts = some.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"))
    drawn = resample_index(counts, replicates, mean_block, seed, by).join(placed, [*by, "source"])
    if native:
        return drawn.groupBy(*by, "replicate").agg(statistic("_r").alias("value"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[:1][[*by, "replicate"]].copy()
        head["value"] = float(statistic(frame.sort_values("i")["_r"].to_numpy()))
        return head

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.schema.fields if f.name in by)
    return drawn.groupBy(*by, "replicate").applyInPandas(one, f"{kinds}, replicate int, value double")


class Sums(NamedTuple):
    """What a statistic of a resample is made of: columns of its count, mean, population variance, and mean of ln(1 + x)."""

    n: Column
    mean: Column
    variance: Column
    growth: Column


def mean_of(s: Sums) -> Column:
    return s.mean


def sharpe_of(s: Sums) -> Column:
    """Annualised, by population deviation; 0 without spread."""
    return F.when(s.variance == 0, F.lit(0.0)).otherwise(F.sqrt(F.lit(float(PERIODS))) * s.mean / F.sqrt(s.variance))


def total_return_of(s: Sums) -> Column:
    return F.exp(s.growth * s.n) - 1.0


def resample_blocks(df: DataFrame, replicates: int, mean_block: float, seed: int, by=ts.KEYS) -> DataFrame:
    """keys, n, replicate, at, size: the blocks of ``resample_index``, a row for each block (n / mean_block of them a replicate) in place of one for each position."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = df.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).where("n > 0")
    # Replicates are dealt out before positions are drawn; only the positions that start a block leave the drawing.
    grid = grid.repartition(parts, *by, "replicate").select(*by, "n", "replicate", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    key = [*by, "replicate", "i"]
    starts = grid.where((F.col("i") == 0) | ts.uniform_below(1.0 / mean_block, seed, *key))
    size = F.coalesce(F.lead("i").over(Window.partitionBy(*by, "replicate").orderBy("i")), F.col("n")) - F.col("i")
    at = F.floor(ts.uniform(1, seed, *key) * F.col("n"))
    return starts.select(*by, "n", "replicate", at.alias("at"), size.cast("long").alias("size"))


def _facts(df: DataFrame, r: str, by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("_mean"), F.var_pop(r).alias("_var"), F.avg(F.log1p(F.when(F.col(r) > -1, F.col(r)))).alias("_growth"))


def resampled_sums(df: DataFrame, r: str, replicates: int, mean_block: float, seed: int, by=ts.KEYS, order: str = "date", block_rows: int | None = None) -> DataFrame:
    """keys, replicate, n, _mean, _var, _growth of each resample, from running sums of the series.

    A block's sums are a difference of two running sums (and one more where it
    runs on around the end), so two or three rows stand for it, whatever its
    length. Sums are of deviations from the mean, which keeps their differences exact
    to rounding. ``block_rows``: for series of more rows, running sums in blocks.
    """
    some = df.where(F.col(r).isNotNull()).select(*by, order, F.col(r).cast("double").alias("_r"))
    facts = _facts(some, "_r", by)
    centred = ts.with_group_facts(some, by, _mean=F.avg("_r")).withColumn("_d", F.col("_r") - F.col("_mean")).withColumn("_g", F.log1p(F.when(F.col("_r") > -1, F.col("_r"))))
    wanted = {"_s1": F.col("_d"), "_s2": F.col("_d") * F.col("_d"), "_sg": F.col("_g")}
    if block_rows:
        rows = store.written(blocks.in_blocks(blocks.positioned(centred, by, [order]), block_rows), "bootstrap-rows")
        sums = blocks.running(rows, {n: (blocks.SUM, c) for n, c in wanted.items()}, by).withColumn("_place", F.col(blocks.POS) + 1)
    else:
        w = ts.spec(by, order)
        sums = centred.select("*", F.row_number().over(w).cast("long").alias("_place"), *[ts.cumulative(F.sum, c, w).alias(n) for n, c in wanted.items()])
    drawn = resample_blocks(facts.select(*by, "n"), replicates, mean_block, seed, by)
    end, n = F.col("at") + F.col("size"), F.col("n")
    corner = lambda place, sign: F.struct(place.alias("_place"), F.lit(sign).alias("_sign"))
    inside = F.array(corner(end, 1.0), corner(F.col("at"), -1.0))
    around = F.array(corner(n, 1.0), corner(F.col("at"), -1.0), corner(end - n, 1.0))
    corners = drawn.select(*by, "replicate", F.explode(F.when(end <= n, inside).otherwise(around)).alias("_c")).select(*by, "replicate", "_c.*").where("_place > 0")
    met = corners.join(sums.select(*by, "_place", *wanted), [*by, "_place"])
    totals = met.groupBy(*by, "replicate").agg(*[F.sum(F.col("_sign") * F.coalesce(c, F.lit(0.0))).alias(c) for c in wanted])
    both = totals.join(facts.select(*by, "n", "_mean"), list(by))
    shift, square = F.col("_s1") / F.col("n"), F.col("_s2") / F.col("n")
    spread = square - shift * shift
    # What rounding leaves of the spread of equal values is none.
    return both.select(*by, "replicate", "n", (F.col("_mean") + shift).alias("_mean"), F.when(spread > square * 1e-12, spread).otherwise(F.lit(0.0)).alias("_var"), (F.col("_sg") / F.col("n")).alias("_growth"))


def _kept(df: DataFrame, r: str, by, order: str) -> DataFrame:
    """The rows that are resampled, written: counts, means, running sums and the observed value each read them."""
    return store.written(df.where(F.col(r).isNotNull()).select(*by, order, r), "resampled")


def _sums() -> Sums:
    return Sums(*[F.col(c) for c in ("n", "_mean", "_var", "_growth")])


def block_bootstrap_ci(df: DataFrame, r: str, statistic: Callable[[Sums], Column], replicates: int = 2000, mean_block: float = 20.0, ci: float = 0.9, seed: int = 0, by=ts.KEYS, order: str = "date", block_rows: int | None = None) -> DataFrame:
    """keys, point, lower, upper of a statistic of sums. Other statistics: ``bootstrap_samples``."""
    df = _kept(df, r, by, order)
    samples = resampled_sums(df, r, replicates, mean_block, seed, by, order, block_rows)
    a = (1 - ci) / 2
    bounds = samples.groupBy(*by).agg(F.percentile(statistic(_sums()), F.array(F.lit(a), F.lit(1 - a))).alias("_q"))
    point = _facts(df, r, by).select(*by, statistic(_sums()).alias("point"))
    return point.join(bounds, list(by)).select(*by, "point", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def bootstrap_p_value(df: DataFrame, r: str, replicates: int = 2000, mean_block: float = 20.0, seed: int = 0, by=ts.KEYS, order: str = "date", block_rows: int | None = None) -> DataFrame:
    """keys, observed, p_value: share of resamples of the mean-centred series whose mean is at least as far from 0 as the observed one."""
    df = _kept(df, r, by, order)
    samples = resampled_sums(df, r, replicates, mean_block, seed, by, order, block_rows)
    observed = df.groupBy(*by).agg(F.avg(r).alias("observed"))
    far = (F.abs(F.col("_mean") - F.col("observed")) >= F.abs("observed")).cast("double")
    return samples.join(observed, list(by)).groupBy(*by).agg(F.first("observed").alias("observed"), F.avg(far).alias("p_value"))


def expected_max_sharpe_under_null(trials: int, spread: float) -> float:
    """Expected best Sharpe ratio of ``trials`` strategies without skill; 0 for one."""
    if trials <= 1:
        return 0.0
    quantile = NormalDist().inv_cdf
    return spread * ((1 - EULER_GAMMA) * quantile(1 - 1 / trials) + EULER_GAMMA * quantile(1 - 1 / (trials * math.e)))


def sharpe_error(n: str, mean: str, std: str, skew: str, excess_kurtosis: str) -> Column:
    """Standard error of a per-period Sharpe ratio from its moments' columns."""
    ratio = F.col(mean) / F.col(std)
    spread = F.lit(1.0) - F.col(skew) * ratio + (F.col(excess_kurtosis) + 2) / 4 * ratio * ratio
    return F.sqrt(F.greatest(spread, F.lit(1e-12)) / (F.col(n) - 1))


def deflated_sharpe(n: int, mean: float, std: float, skew: float, excess_kurtosis: float, trial_sharpes: list[float]) -> float:
    """Probability of skill given the trials. With one trial the benchmark is 0."""
    ratio = mean / std
    error = math.sqrt(max(1 - skew * ratio + (excess_kurtosis + 2) / 4 * ratio**2, 1e-12) / (n - 1))
    spread = float(np.std(trial_sharpes, ddof=1)) if len(trial_sharpes) > 1 else error
    return NormalDist().cdf((ratio - expected_max_sharpe_under_null(len(trial_sharpes), spread)) / error)


def deflated_sharpe_ratio(df: DataFrame, r: str, trial_sharpes: list[float], by=ts.KEYS) -> DataFrame:
    """keys, n, dsr: moments are one aggregate for each key, and the ratio is a column of those; NULL for three rows or fewer, or without spread."""
    trials = [float(x) for x in trial_sharpes]
    base = moments(df, r, by).withColumn("_ratio", ts.ratio("mean", "std")).withColumn("_error", sharpe_error("n", "mean", "std", "skew", "kurtosis"))
    count = float(len(trials))
    spread = F.lit(float(np.std(trials, ddof=1))) if count > 1 else F.col("_error")
    best = F.lit(0.0)
    if count > 1:
        best = spread * ((1 - EULER_GAMMA) * normal.quantile(F.lit(1 - 1 / count)) + EULER_GAMMA * normal.quantile(F.lit(1 - 1 / (count * math.e))))
    dsr = normal.cdf((F.col("_ratio") - best) / F.col("_error"))
    return base.select(*by, "n", F.when(F.col("n") > 3, dsr).alias("dsr"))
