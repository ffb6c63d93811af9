"""Block forms against their plain namesakes; sliding ranks, resamples from running sums, normal columns, assignment."""

import math
import time
from itertools import permutations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal, ts
from tidemark.operators import backtest as bt
from tidemark.operators import blocks, evaluate, models, portfolio, regimes, simulate, spread
from tidemark.operators import statistics as st


@pytest.fixture(scope="module")
def rows(spark):
    """Two series, one of nine tenths of the rows, with equal and missing values."""
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"series_id": np.where(np.arange(1500) % 10 == 3, "small", "large"), "date": np.arange(1500)})
    frame["value"] = np.where(rng.random(1500) < 0.3, 0.5, rng.normal(size=1500).round(2))
    frame["fwd"] = (0.01 * frame["value"] + rng.normal(0, 0.02, 1500)).round(3)
    frame["probability"] = rng.random(1500)
    frame["next_return"] = rng.normal(0, 0.01, 1500)
    frame["target"] = (rng.random(1500) < 0.4).astype(int)
    frame["state"] = rng.integers(0, 2, 1500)
    return spark.createDataFrame(frame).withColumn("value", F.when(F.col("date") % 97 != 5, F.col("value"))).cache()


def same(one, two, digits=9):
    cut = lambda df: sorted(str(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(df.columns)).collect())
    assert sorted(one.columns) == sorted(two.columns)
    assert cut(one) == cut(two)


@pytest.mark.parametrize("block_rows", [50, 5000])
def test_block_forms_equal_plain_forms(rows, block_rows):
    by = ts.KEYS
    predictions = rows.select("series_id", "date", "probability", "next_return")
    same(spread.run_backtest(predictions, block_rows=block_rows), bt.run_backtest(predictions))
    same(spread.runs(rows, "state", block_rows=block_rows), ts.runs(rows, "state"))
    same(spread.information_coefficient(rows, by=by, block_rows=block_rows), evaluate.information_coefficient(rows, by=by))
    same(spread.auc(rows, "value", "target", by, ["date"], block_rows), models.auc(rows, "value", "target", by))
    same(evaluate.rolling_ic(rows, 40, by=by, block_rows=block_rows), evaluate.rolling_ic(rows, 40, by=by, native=True))


def test_positions_in_place_of_percentiles(rows):
    same(spread.quantile_returns(rows, by=ts.KEYS), evaluate.quantile_returns(rows, by=ts.KEYS))
    panel = rows.where("value is not null").withColumn("t", F.col("date") % 7)
    same(spread.quantile_long_short(panel, "value", ["t"], "date").select("t", "date", "weight"), portfolio.quantile_long_short(panel, "value", ["t"], "date").select("t", "date", "weight"))


@pytest.mark.parametrize("window", [5, 60, 2000])
def test_sliding_ranks(window):
    rng = np.random.default_rng(window)
    n = window + 40
    x, y = rng.integers(0, 9, n).astype(float), rng.normal(size=n).round(1)
    x[:window] = 3.0 if window == 5 else x[:window]
    got = evaluate.sliding_spearman(x, y, window, cells=7 * window)
    want = [pd.Series(x[k : k + window]).rank().corr(pd.Series(y[k : k + window]).rank()) if x[k : k + window].std() > 0 else np.nan for k in range(n - window + 1)]
    assert got == pytest.approx(want, abs=1e-12, nan_ok=True)
    assert evaluate.sliding_spearman(x[:3], y[:3], 5).size == 0


@pytest.mark.parametrize(("n", "window", "cells"), [(700, 60, 1 << 16), (700, 60, 600), (4300, 2000, 1 << 16), (2000, 2000, 64), (61, 60, 1 << 16)])
def test_ranks_kept_up_row_by_row(n, window, cells):
    """Every window ranked by itself, with ties, infinities and a stretch of one value."""
    rng = np.random.default_rng(n + window)
    x, y = np.round(rng.normal(size=n), 1), rng.normal(size=n)
    x[100 : 100 + window + 5] = 2.5
    y[::50] = np.inf
    got = evaluate.sliding_spearman(x, y, window, cells)
    assert got.size == n - window + 1
    for k in range(0, got.size, max(1, got.size // 80)):
        a, b = (pd.Series(v[k : k + window]).rank().to_numpy() for v in (x, y))
        if np.ptp(a) == 0:
            assert np.isnan(got[k])
        else:
            assert got[k] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)


@pytest.mark.parametrize("block_rows", [None, 60])
def test_resamples_from_running_sums(rows, block_rows):
    """Each replicate's mean and variance are those of the rows that its positions name."""
    some = rows.select("series_id", "date", "next_return")
    got = st.resampled_sums(some, "next_return", 40, 7.0, 3, block_rows=block_rows)
    plain = lambda f: st.bootstrap_samples(some, "next_return", f, 40, 7.0, 3)
    same(got.select("series_id", "replicate", F.col("_mean").alias("value")), plain(F.avg), 12)
    same(got.select("series_id", "replicate", F.col("_var").alias("value")), plain(F.var_pop), 12)
    same(got.select("series_id", "replicate", st.total_return_of(st._sums()).alias("value")), plain(bt.total_return), 9)


def test_constant_series_have_no_spread(spark):
    flat = spark.createDataFrame([("a", k, 0.001) for k in range(100)], "series_id string, date int, r double")
    assert st.block_bootstrap_ci(flat, "r", st.sharpe_of, 50).select("point", "lower", "upper").first() == (0.0, 0.0, 0.0)


def test_draws_below_a_share(spark):
    rows = spark.range(20_000).select("id", ts.uniform(0, 9, "id").alias("u"))
    for share in (0.05, 1 / 3, 1e-3, 0.999, 1.0):
        assert rows.where((F.col("u") < share) != ts.uniform_below(share, 9, "id")).count() == 0


def test_normal_columns(spark):
    xs = [float(x) for x in np.linspace(-12, 12, 401)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.cdf("x")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=2e-15)
    ps = [10.0**-k for k in range(1, 300, 9)] + [float(p) for p in np.linspace(0.001, 0.999, 300)]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal.quantile("p")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-12)
    edges = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(normal.quantile("p"), normal.cdf(F.lit(None).cast("double"))).collect()
    assert all(r[0] is None and r[1] is None for r in edges)


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(1)
    for k in range(8):
        for turn in range(12 if k < 7 else 3):
            gain = rng.integers(0, 5, (k, k)).astype(float) if turn % 2 else rng.normal(size=(k, k))
            found = regimes.assignment(gain)
            assert sorted(found.tolist()) == list(range(k))
            best = max(sum(gain[i, p[i]] for i in range(k)) for p in permutations(range(k)))
            assert gain[np.arange(k), found].sum() == pytest.approx(best)
    began = time.time()
    regimes.assignment(rng.random((60, 60)))
    assert time.time() - began < 1


@pytest.mark.parametrize("block_rows", [1, 37, 10_000])
def test_filter_in_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"series_id": ["a"] * 150 + ["b"] * 30, "date": [*range(150), *range(30)], "return": rng.normal(0, 0.2, 180)})
    if block_rows == 1:
        frame = frame.iloc[130:]
    data = spark.createDataFrame(frame)
    law = (simulate.TRANSITION, [0.0, 0.02, -0.02], [0.05, 0.1, 0.3])
    flat = lambda df: df.select("series_id", "date", "log_likelihood", *[F.col("probabilities")[k].alias(f"p{k}") for k in range(3)])
    same(flat(regimes.hamilton_filter_in_blocks(data, *law, block_rows=block_rows)), flat(regimes.hamilton_filter(data, *law)))
    many = rng.random((1000, 4, 4))
    plain = np.eye(4)
    for m in many:
        plain = m @ plain / (m @ plain).sum()
    assert regimes.block_product(many) == pytest.approx(plain, rel=1e-9)


def test_rows_of_a_long_key_lie_in_several_tasks(rows):
    plan = evaluate.rolling_ic(rows, 40, by=ts.KEYS, block_rows=100)
    sizes = [r["n"] for r in blocks.in_blocks(blocks.positioned(rows, ts.KEYS, ["date"]), 100).groupBy("series_id", "_block").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) == 100 and "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
