"""Group facts joined back to rows, several series at once, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import backtest as bt
from tidemark.operators import evaluate as ev
from tidemark.operators import folds, portfolio
from tidemark.plans import experiments

SIGNALS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    rows = []
    for series, n in (("x", 130), ("y", 90)):
        base = rng.normal(size=(n, 4))
        base[:, 1] += 0.6 * base[:, 0]
        base[:, 2] += 0.3 * base[:, 1]
        rows.append(pd.DataFrame(base, columns=[*SIGNALS, "fwd"]).assign(series_id=series, date=pd.bdate_range("2020-01-01", periods=n).date))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def wide(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


def by_series(df, column):
    got = df.toPandas().sort_values(["series_id", "date"])
    return {k: g[column].to_numpy() for k, g in got.groupby("series_id")}


def test_group_facts_keep_rows_and_null_keys(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0), (None, 7.0), ("z", None)], "k string, v double")
    got = sorted(((r.k, r.v, r.m) for r in ts.with_group_facts(df, ["k"], m=F.avg("v")).collect()), key=str)
    assert got == sorted([("x", 1.0, 2.0), ("x", 3.0, 2.0), (None, 5.0, 6.0), (None, 7.0, 6.0), ("z", None, None)], key=str)


def test_ridge_is_fitted_by_series(wide, pdf):
    got = by_series(ev.combine_ridge(wide, SIGNALS, alpha=2.0), "combined")
    for k, g in pdf.groupby("series_id"):
        z = (g[SIGNALS] - g[SIGNALS].mean()) / g[SIGNALS].std()
        x = z.to_numpy()
        beta = np.linalg.solve(x.T @ x + 2.0 * np.eye(3), x.T @ (g["fwd"] - g["fwd"].mean()).to_numpy())
        assert np.allclose(got[k], x @ beta)


def test_residuals_by_series(wide, pdf):
    out = ev.orthogonalize(wide, SIGNALS)
    assert out.columns == wide.columns
    for name in SIGNALS[1:]:
        got = by_series(out, name)
        for k, g in pdf.groupby("series_id"):
            before = np.column_stack([np.ones(len(g)), *[by_series(out, p)[k] for p in SIGNALS[: SIGNALS.index(name)]]])
            y = g[name].to_numpy()
            assert np.allclose(got[k], y - before @ np.linalg.lstsq(before, y, rcond=None)[0])
    twin = ev.orthogonalize(wide.withColumn("b", F.col("a") * 2), SIGNALS)
    assert all(np.abs(v).max() < 1e-9 for v in by_series(twin, "b").values())


def test_rolling_rank_correlation_forms_agree(wide):
    long = wide.select("series_id", "date", F.lit("a").alias("signal"), F.round("a", 1).alias("value"), "fwd")
    one, two = (ev.rolling_ic(long, 20, native=n).orderBy("series_id", "date").toPandas() for n in (False, True))
    assert len(one) == len(two) > 0 and np.allclose(one["ic"], two["ic"])


def test_fold_counts_equal_fold_rows(spark):
    df = spark.createDataFrame([(s, k, int((k * 7) % 3 == 0)) for s, n in (("x", 60), ("y", 41), ("z", 5)) for k in range(n)], "series_id string, date int, target int")
    for embargo in (0, 4, 50):
        rows = folds.expanding_rows(df, 20, 7, embargo)
        want = rows.groupBy("series_id", "fold").agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"), F.sum(F.when(~F.col("is_test"), F.col("target")).otherwise(0)).alias("train_positives"))
        got = folds.fold_counts(df, 20, 7, [embargo]).where(f"embargo = {embargo}").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_explained_share(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 4.0)], "k string, v double")
    assert sorted(r.share for r in portfolio.explained_share(df, "v").collect()) == [0.125, 0.375, 0.5]
    assert sorted(r.share for r in portfolio.explained_share(df, "v", ["k"]).collect()) == [0.25, 0.75, 1.0]


def test_lookback_grid(spark):
    prices = [100.0, 101.0, 99.0, 103.0, 104.0, 102.0, 105.0]
    df = spark.createDataFrame([("x", k, p, p / prices[k - 1] - 1) for k, p in enumerate(prices) if k], "series_id string, date int, price double, return double")
    got = {(r.lookback, r.cost): (r.n, r.sharpe) for r in bt.lookback_grid(df, [1, 2], [0.0, 0.01]).collect()}
    p = np.array(prices[1:])
    for look in (1, 2):
        position = np.sign(p[look:] / p[:-look] - 1)[:-1]
        ahead = (p[1:] / p[:-1] - 1)[look:]
        for cost in (0.0, 0.01):
            net = position * ahead - np.abs(np.diff(position, prepend=0)) * cost
            assert got[look, cost] == (len(net), pytest.approx(252**0.5 * net.mean() / net.std(ddof=1)))


def test_draws_are_uniform_and_independent(spark):
    got = spark.range(4000).select(ts.uniform(0, 5, "id").alias("u"), ts.uniform(1, 5, "id").alias("v"), ts.uniform(0, 6, "id").alias("w")).toPandas()
    assert got.min().min() > 0 and got.max().max() < 1 and np.allclose(got.mean(), 0.5, atol=0.02) and np.allclose(got.std(), 12**-0.5, atol=0.01)
    assert np.abs(got.corr().to_numpy() - np.eye(3)).max() < 0.06


def test_frames_are_released(spark):
    kept = spark.range(3).persist()
    frames = experiments.Frames({"n": kept.groupBy().count()}, kept)
    assert frames["n"].first()[0] == 3 and kept.is_cached
    frames.release()
    assert not kept.is_cached
