"""Signal evaluation against pandas and closed forms."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import evaluate as ev

SCHEMA = "series_id string, signal string, date int, value double, fwd double, price double"


def pairs(n=600, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    if ties:
        x = np.round(x)
    y = 0.5 * x + 2 * rng.normal(size=n)
    return pd.DataFrame({"series_id": "A", "signal": "s", "date": range(n), "value": x, "fwd": y, "price": 100 + np.cumsum(rng.normal(size=n)) * 0.1})


def spearman(a, b):
    return a.rank().corr(b.rank())


@pytest.mark.parametrize("ties", [False, True])
def test_information_coefficient(spark, ties):
    p = pairs(ties=ties)
    p.loc[5, "value"] = None
    got = ev.information_coefficient(spark.createDataFrame(p, SCHEMA)).first()
    q = p.dropna()
    assert got.n == len(q) and got.ic == pytest.approx(spearman(q["value"], q["fwd"]))
    short = ev.information_coefficient(spark.createDataFrame(p.tail(9), SCHEMA)).first()
    assert short.ic is None
    flat = ev.information_coefficient(spark.createDataFrame(p.assign(value=1.0), SCHEMA)).first()
    assert flat.ic is None


def test_rolling_and_block_coefficients(spark):
    p = pairs(200, ties=True)
    df = spark.createDataFrame(p, SCHEMA)
    rolled = ev.rolling_ic(df, 60).orderBy("date").collect()
    want = [spearman(p["value"][i - 59 : i + 1], p["fwd"][i - 59 : i + 1]) for i in range(59, 200)]
    assert [r.date for r in rolled] == list(range(59, 200)) and np.allclose([r.ic for r in rolled], want)
    assert np.allclose([r.ic for r in ev.rolling_ic(df, 60, native=True).orderBy("date").collect()], want)
    assert ev.rolling_ic(spark.createDataFrame(p.assign(value=1.0), SCHEMA), 60).where("ic is not null").count() == 0
    blocks = ev.block_ic(df, 60).orderBy("block").collect()
    assert len(blocks) == 3 and np.allclose([r.ic for r in blocks], [spearman(p["value"][k : k + 60], p["fwd"][k : k + 60]) for k in (0, 60, 120)])
    t = ev.non_overlapping_ic_t_stat(df, 60).first()
    ics = pd.Series([r.ic for r in blocks])
    assert t.t_stat == pytest.approx(ics.mean() / (ics.std() / 3**0.5))
    assert ev.ic_t_stat(ev.block_ic(df, 150)).first().t_stat is None


def test_decay_autocorrelation_turnover_and_sharpe(spark):
    p = pairs(300)
    df = spark.createDataFrame(p, SCHEMA)
    got = {r.horizon: r.ic for r in ev.ic_decay(df).collect()}
    for h in (1, 5, 10, 20):
        f = p["price"].pct_change(h).shift(-h)
        keep = f.notna()
        assert got[h] == pytest.approx(spearman(p["value"][keep], f[keep]))
    assert ev.signal_autocorrelation(df).first().autocorrelation == pytest.approx(p["value"].autocorr(1))
    sign = np.sign(p["value"])
    assert ev.implied_turnover(df).first().turnover == pytest.approx((sign.diff().abs() > 0).mean())
    net = sign * p["fwd"] - sign.diff().abs().fillna(sign.abs()) * 0.0002
    assert ev.signal_sharpe(df).first().sharpe == pytest.approx(252**0.5 * net.mean() / net.std())
    flips = spark.createDataFrame(p.assign(value=[1.0, -1.0] * 150), SCHEMA)
    assert ev.implied_turnover(flips).first().turnover == pytest.approx(299 / 300)


def test_quantile_returns_and_report(spark):
    p = pairs(500, seed=3)
    df = spark.createDataFrame(p, SCHEMA)
    bins = ev.quantile_returns(df).orderBy("bin").collect()
    want = p.groupby(pd.qcut(p["value"], 5, labels=False))["fwd"].agg(["mean", "count"])
    assert np.allclose([r.mean_return for r in bins], want["mean"]) and [r.n for r in bins] == list(want["count"])
    report = ev.alpha_report(df).first()
    assert set(report.decay) == {1, 5, 10, 20} and len(report.bins) == 5 and report.naive_t_stat > report.block_t_stat


def test_naive_t_statistic_overstates(spark):
    parts = [pairs(400, s).assign(signal=f"s{s}", fwd=np.random.default_rng(100 + s).normal(size=400)) for s in range(12)]
    df = spark.createDataFrame(pd.concat(parts), SCHEMA)
    naive = ev.ic_t_stat(ev.rolling_ic(df)).toPandas()["t_stat"].abs()
    honest = ev.non_overlapping_ic_t_stat(df).toPandas()["t_stat"].abs()
    assert (naive > 2).mean() > 0.3 and (honest > 3).mean() < 0.3


def wide(spark, n=400):
    rng = np.random.default_rng(8)
    a = rng.normal(size=n)
    b = 0.8 * a + 0.3 * rng.normal(size=n)
    c = rng.normal(size=n) - a
    p = pd.DataFrame({"series_id": "A", "date": range(n), "a": a, "b": b, "c": c, "fwd": 0.2 * a + rng.normal(size=n)})
    return p, spark.createDataFrame(p, "series_id string, date int, a double, b double, c double, fwd double")


def test_matrices(spark):
    p, df = wide(spark)
    got = {(r.a, r.b): r.rho for r in ev.signal_correlation(df, ["a", "b", "c"]).collect()}
    want = p[["a", "b", "c"]].corr()
    assert all(rho == pytest.approx(want.loc[k]) for k, rho in got.items())
    o = ev.orthogonalize(df, ["a", "b", "c"]).toPandas().sort_values("date")
    assert np.allclose(o["a"], p["a"]) and abs(np.corrcoef(o[["a", "b", "c"]].T) - np.eye(3)).max() < 1e-8
    design = np.column_stack((np.ones(len(p)), p["a"]))
    assert np.allclose(o["b"], p["b"] - design @ np.linalg.lstsq(design, p["b"], rcond=None)[0])


def test_combinations(spark):
    p, df = wide(spark)
    z = (p[["a", "b", "c"]] - p[["a", "b", "c"]].mean()) / p[["a", "b", "c"]].std()
    by_date = lambda x: x.toPandas().sort_values("date")["combined"].to_numpy()
    assert np.allclose(by_date(ev.combine_equal_weight(df, ["a", "b", "c"])), z.mean(axis=1))
    ics = pd.Series({c: spearman(p[c], p["fwd"]) for c in "abc"})
    assert np.allclose(by_date(ev.combine_ic_weighted(df, ["a", "b", "c"])), z @ (ics / ics.abs().sum()))
    y = p["fwd"] - p["fwd"].mean()
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ y)
    assert np.allclose(by_date(ev.combine_ridge(df, ["a", "b", "c"])), z @ beta)
    holes = spark.createDataFrame([("A", k, None if k == 0 else float(k), None if k < 2 else float(-k), 1.0) for k in range(5)], "series_id string, date int, a double, b double, fwd double")
    row = ev.combine_equal_weight(holes, ["a", "b"]).orderBy("date").first()
    assert row.combined is None
