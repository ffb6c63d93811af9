"""Features, signals and window helpers against pandas, and causality under shocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import schema, ts
from tidemark.operators import features as ft


def market(n=420, seed=1, series="A"):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 0.01, n)
    return pd.DataFrame({"series_id": series, "date": pd.bdate_range("2018-01-01", periods=n).date, "price": 100 * np.exp(np.cumsum(r)), "return": r})


def frame(spark, *parts):
    return spark.createDataFrame(pd.concat(parts), "series_id string, date date, price double, return double")


def collect(df):
    return df.toPandas().sort_values(["series_id", "date"]).reset_index(drop=True)


def test_features_equal_pandas(spark):
    a = market()
    got = collect(ft.build_features(frame(spark, a, market(seed=2, series="B"))).where("series_id = 'A'"))
    want = a.copy()
    for k in ft.LAGS:
        want[f"return_lag_{k}"] = a["return"].shift(k)
    for n in ft.WINDOWS:
        want[f"momentum_{n}"] = a["price"].pct_change(n).shift(1)
        want[f"volatility_{n}"] = a["return"].rolling(n).std().shift(1)
        want[f"drawdown_{n}"] = a["price"] / a["price"].rolling(n).max().shift(1) - 1
    want["target"] = (a["return"].shift(-1) > 0).astype(int)
    want["next_return"] = a["return"].shift(-1)
    want = want.dropna().reset_index(drop=True)
    assert len(got) == len(want) == 420 - 62
    assert list(got["target"]) == list(want["target"])
    names = schema.feature_columns(frame(spark, a).limit(0).transform(ft.build_features))
    assert len(names) == 17
    assert np.allclose(got[names], want[names], atol=1e-10)


def test_signals_equal_pandas(spark):
    a = market(700)
    df = ft.vol_managed_signal(ft.mean_reversion_signal(ft.momentum_signal(frame(spark, a))))
    got = collect(df)

    def z(x):
        return ((x - x.rolling(250, min_periods=60).mean()) / x.rolling(250, min_periods=60).std().replace(0, np.nan)).shift(1)

    for name, want in (("alpha_momentum", z(a["price"].pct_change(60))), ("alpha_mean_reversion", -z(a["price"].pct_change(5))), ("alpha_vol_managed", -z(a["return"].rolling(20).std()))):
        assert (got[name].isna() == want.isna()).all(), name
        assert np.allclose(got[name].dropna(), want.dropna(), atol=1e-9), name


def test_nothing_looks_ahead(spark):
    a = market(500)
    b = a.copy()
    rng = np.random.default_rng(9)
    b.loc[400:, "return"] = rng.normal(0, 0.05, 100)
    b.loc[400:, "price"] = b["price"][399] * np.exp(np.cumsum(b["return"][400:]))
    build = lambda x: ft.vol_managed_signal(ft.mean_reversion_signal(ft.momentum_signal(ft.build_features(frame(spark, x), drop_incomplete=False))))
    one, two = collect(build(a)), collect(build(b))
    names = [c for c in one.columns if c.startswith(("return_lag", "momentum", "volatility", "drawdown", "alpha"))]
    pd.testing.assert_frame_equal(one.loc[:399, names], two.loc[:399, names])
    assert not np.allclose(one.loc[410:450, "momentum_5"], two.loc[410:450, "momentum_5"])


def test_one_exchange_for_all_features(spark):
    plan = ft.build_features(frame(spark, market(80)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_placebo_is_normal_and_independent_of_partitions(spark):
    df = frame(spark, market(2000))
    one = collect(ft.placebo_signal(df, 5))
    two = collect(ft.placebo_signal(df.repartition(7), 5))
    assert (one["alpha_placebo"] == two["alpha_placebo"]).all()
    assert abs(one["alpha_placebo"].mean()) < 0.1 and abs(one["alpha_placebo"].std() - 1) < 0.1
    assert not (one["alpha_placebo"] == collect(ft.placebo_signal(df, 6))["alpha_placebo"]).any()


def test_regime_transition_signal(spark):
    df = spark.createDataFrame([("A", k, 0.1 * k, 0.2, 1 - 0.1 * k) for k in range(4)], "series_id string, date int, regime_prob_0 double, regime_prob_1 double, regime_prob_2 double")
    got = [r.alpha_regime_transition for r in ft.regime_transition_signal(df).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1.0, 0.8, 0.6])
    with pytest.raises(ValueError):
        ft.regime_transition_signal(df.select("series_id", "date", "regime_prob_0"))


def test_regime_columns_sort_by_number(spark):
    df = spark.range(1).select(*[F.lit(0.0).alias(f"regime_prob_{k}") for k in (10, 2, 0)])
    assert schema.regime_columns(df) == ["regime_prob_0", "regime_prob_2", "regime_prob_10"]


@pytest.mark.parametrize("values", [list(np.random.default_rng(0).normal(size=97)), [1.0] * 30 + [2.0] * 5 + [3.0, 4.0, 5.0], [1.0] * 10, list(range(11))])
def test_quantile_bins_equal_qcut(spark, values):
    df = spark.createDataFrame([("A", float(v)) for v in values], "k string, v double")
    got = sorted((r.v, r.bin) for r in ts.quantile_bins(df, "v", 5, ["k"]).collect())
    cut = pd.qcut(pd.Series(sorted(map(float, values))), 5, labels=False, duplicates="drop")
    if cut.notna().all():
        assert [b for _, b in got] == list(cut.astype(int))


def test_average_rank_and_runs(spark):
    df = spark.createDataFrame([("A", k, float(v)) for k, v in enumerate([3, 1, 1, 2, 2, 2])], "k string, date int, v double")
    ranks = [r.r for r in df.select("date", ts.average_rank("v", ["k"]).alias("r")).orderBy("date").collect()]
    assert ranks == [6.0, 1.5, 1.5, 4.0, 4.0, 4.0]
    spans = ts.runs(df, "v", ["k"]).orderBy("run").collect()
    assert [(r.value, r.first, r.last, r.length) for r in spans] == [(3, 0, 0, 1), (1, 1, 2, 2), (2, 3, 5, 3)]


def test_zero_denominators_are_null(spark):
    df = spark.createDataFrame([("A", 0, 0.0, 0.0), ("A", 1, 5.0, 0.0)], "series_id string, date int, price double, return double")
    assert df.select(ts.pct_change("price", 1, ts.spec()).alias("x")).orderBy("x").collect()[-1].x is None
