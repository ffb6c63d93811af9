"""Backtests, sizing, bootstrap and deflation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import statistics as st

SCHEMA = "series_id string, date int, probability double, next_return double, target int"


def predictions(spark, p, r):
    rows = [("A", k, float(a), float(b), int(b > 0)) for k, (a, b) in enumerate(zip(p, r, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def ledger(df):
    return df.orderBy("date").toPandas()


def test_positions_turnover_and_compounding(spark):
    got = ledger(bt.run_backtest(predictions(spark, [0.6, 0.5, 0.4, 0.4], [0.01, 0.02, -0.01, 0.03]), 0.55, 0.001))
    assert list(got["position"]) == [1, 0, -1, -1] and list(got["turnover"]) == [1, 1, 1, 0]
    net = np.array([0.01 - 0.001, -0.001, 0.01 - 0.001, -0.03])
    assert np.allclose(got["strategy_return"], net) and np.allclose(got["equity"], np.cumprod(1 + net))
    assert np.allclose(got["drawdown"], got["equity"] / got["equity"].cummax() - 1)


def test_threshold_edges(spark):
    got = ledger(bt.run_backtest(predictions(spark, [0.5, 0.45, 0.55], [0.0] * 3), 0.5))
    assert got["position"][0] == -1  # both bounds are met: the short side wins
    got = ledger(bt.run_backtest(predictions(spark, [0.45, 0.55], [0.0] * 2), 0.55))
    assert list(got["position"]) == [0, 1]  # 1 - 0.55 is a little below 0.45


def test_metrics(spark):
    rng = np.random.default_rng(2)
    df = bt.run_backtest(predictions(spark, rng.random(300), rng.normal(0, 0.01, 300)))
    p, m = ledger(df), bt.backtest_metrics(df).first()
    assert m.total_return == pytest.approx(p["equity"].iloc[-1] - 1) and m.max_drawdown == pytest.approx(p["drawdown"].min())
    assert m.annualised_sharpe == pytest.approx(252**0.5 * p["strategy_return"].mean() / p["strategy_return"].std())
    assert m.active_days == pytest.approx((p["position"] != 0).mean()) and m.mean_turnover == pytest.approx(p["turnover"].mean())
    flat = bt.backtest_metrics(bt.run_backtest(predictions(spark, [0.5] * 5, [0.01] * 5))).first()
    assert flat.annualised_sharpe == 0 and flat.total_return == 0


def test_baselines(spark):
    hold = ledger(bt.buy_and_hold(predictions(spark, [0.1] * 5, [0.01] * 5), 0.001))
    assert list(hold["position"]) == [1] * 5 and hold["turnover"].sum() == 1
    df = predictions(spark, [0.5] * 500, [0.01] * 500)
    one, two, three = (list(ledger(bt.random_signal(df, seed=s))["position"]) for s in (0, 0, 1))
    assert one == two != three and 0.8 < np.mean(np.array(one) != 0) <= 1


def test_vol_target(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, 300)
    r[150:] *= 4
    p = rng.random(300)
    got = ledger(bt.run_vol_targeted_backtest(predictions(spark, p, r)))
    vol = pd.Series(r).shift(1).rolling(20).std()
    scale = (0.01 / vol.replace(0, np.nan)).clip(upper=3).fillna(0)
    assert np.allclose(got["position"], np.where(p <= 1 - 0.54, -1, np.where(p >= 0.54, 1, 0)) * scale)
    assert abs(got["position"][200:]).mean() < abs(got["position"][30:150]).mean()
    changed = r.copy()
    changed[200:] = 0.5
    later = ledger(bt.run_vol_targeted_backtest(predictions(spark, p, changed)))
    assert np.allclose(got["position"][:201], later["position"][:201])
    assert bt.backtest_metrics(bt.run_vol_targeted_backtest(predictions(spark, p, r))).first().mean_gross_leverage <= 3
    scales = spark.createDataFrame([(v,) for v in (0.005, 0.01, 0.0, None, 0.02)], "v double").select(bt.vol_target_scale("v", 0.01, 1.5).alias("s"))
    assert [x.s for x in scales.collect()] == [1.5, 1.0, 0.0, 0.0, 0.5]


def test_grid_equals_single_runs(spark):
    rng = np.random.default_rng(5)
    df = predictions(spark, rng.random(120), rng.normal(0, 0.01, 120))
    grid = {(x.threshold, x.cost): x.total_return for x in bt.grid_backtest(df, [0.5, 0.6], [0.0, 0.01]).collect()}
    assert len(grid) == 4
    for (t, c), value in grid.items():
        assert value == pytest.approx(bt.backtest_metrics(bt.run_backtest(df, t, c)).first().total_return)


def test_kelly_and_sharpe(spark):
    r = np.random.default_rng(6).normal(0.001, 0.02, 500)
    df = spark.createDataFrame([("A", float(x)) for x in r], "series_id string, r double")
    got = df.groupBy("series_id").agg(bt.kelly_fraction("r").alias("k"), bt.fractional_kelly("r", 0.25).alias("q"), bt.annualized_sharpe("r").alias("s"), bt.total_return("r").alias("t")).first()
    assert got.k == pytest.approx(r.mean() / r.var(ddof=1)) and got.q == pytest.approx(got.k / 4)
    assert got.s == pytest.approx(252**0.5 * r.mean() / r.std()) and got.t == pytest.approx(np.prod(1 + r) - 1)
    same = spark.createDataFrame([("A", 0.01)] * 4, "series_id string, r double").groupBy("series_id").agg(bt.kelly_fraction("r").alias("k"), bt.annualized_sharpe("r").alias("s")).first()
    assert same.k == 0 and same.s == 0


def test_moments(spark):
    r = pd.Series(np.random.default_rng(7).standard_t(5, 300))
    got = st.moments(spark.createDataFrame([("A", float(x)) for x in r], "series_id string, r double"), "r").first()
    assert got.skew == pytest.approx(r.skew()) and got.kurtosis == pytest.approx(r.kurt()) and got.std == pytest.approx(r.std())


def series(spark, r):
    return spark.createDataFrame([("A", k, float(x)) for k, x in enumerate(r)], "series_id string, date int, r double")


def test_resampled_blocks(spark):
    counts = spark.createDataFrame([("A", 50)], "series_id string, n int")
    got = st.resample_index(counts, 40, 10.0, 3).toPandas().sort_values(["replicate", "i"])
    assert len(got) == 2000 and got["source"].between(0, 49).all()
    steps = got.groupby("replicate")["source"].diff().dropna()
    follows = ((steps == 1) | (steps == -49)).mean()
    assert 0.85 < follows < 0.95
    again = st.resample_index(counts.repartition(3), 40, 10.0, 3).toPandas().sort_values(["replicate", "i"])
    assert (again["source"].to_numpy() == got["source"].to_numpy()).all()


def test_bootstrap_interval_and_p_value(spark):
    rng = np.random.default_rng(8)
    strong, none = rng.normal(0.004, 0.01, 400), rng.normal(0, 0.01, 400)
    ci = st.block_bootstrap_ci(series(spark, strong), "r", st.sharpe_of, 200).first()
    assert ci.lower < ci.point < ci.upper and ci.lower > 0
    assert st.bootstrap_p_value(series(spark, strong), "r", replicates=200).first().p_value < 0.05
    assert st.bootstrap_p_value(series(spark, none - none.mean() * 0.9), "r", replicates=200).first().p_value > 0.05
    own = st.bootstrap_samples(series(spark, strong), "r", lambda x: float(np.median(x)), 20, 10.0, 1, native=False).toPandas()
    assert len(own) == 20 and own["value"].std() > 0


def test_deflation(spark):
    assert st.expected_max_sharpe_under_null(1, 1.0) == 0
    assert st.expected_max_sharpe_under_null(100, 0.1) > st.expected_max_sharpe_under_null(10, 0.1) > 0
    one = st.deflated_sharpe(500, 0.001, 0.01, 0.0, 0.0, [0.1])
    many = st.deflated_sharpe(500, 0.001, 0.01, 0.0, 0.0, list(np.linspace(-0.1, 0.1, 50)))
    assert 0 <= many < one <= 1
    r = np.random.default_rng(9).normal(0.001, 0.01, 500)
    got = st.deflated_sharpe_ratio(series(spark, r), "r", [0.05, 0.02]).first()
    s = pd.Series(r)
    assert got.dsr == pytest.approx(st.deflated_sharpe(500, s.mean(), s.std(), s.skew(), s.kurt(), [0.05, 0.02]))
    assert not math.isnan(got.dsr)


def test_no_null_leaks(spark):
    df = series(spark, [0.01, 0.02]).withColumn("r", F.when(F.col("date") == 0, F.col("r")))
    assert st.moments(df, "r").first().std is None
