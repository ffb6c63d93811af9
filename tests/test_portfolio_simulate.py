"""Covariances, weights and simulators against closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio as pf
from tidemark.operators import simulate as sm


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "t long, x array<double>")


def test_cross_products(spark):
    x = np.random.default_rng(0).normal(size=(200, 6))
    data = pf.cross_products(vectors(spark, x).repartition(5))
    assert np.allclose(data.covariance(), np.cov(x.T)) and np.allclose(data.correlation(), np.corrcoef(x.T)) and data.n_obs == 200
    long = vectors(spark, x).select("t", F.posexplode("x").alias("asset", "r"))
    cells = {(r.i, r.j): r.cov for r in pf.long_covariance(long).collect()}
    assert all(v == pytest.approx(np.cov(x.T)[k]) for k, v in cells.items())
    assert np.allclose(pf.cross_products(pf.to_vectors(long)).covariance(), np.cov(x.T))
    with pytest.raises(ValueError):
        pf.cross_products(vectors(spark, x).where("t < 0"))


def test_ledoit_wolf_equals_the_definition(spark):
    x = np.random.default_rng(2).normal(size=(60, 12)) @ np.diag(np.linspace(0.5, 2, 12))
    shrunk, delta = pf.ledoit_wolf(pf.cross_products(vectors(spark, x)))
    d = x - x.mean(axis=0)
    s = d.T @ d / 60
    target = np.trace(s) / 12 * np.eye(12)
    phi = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in d])
    want = min(1, phi / ((s - target) ** 2).sum() / 60)
    assert delta == pytest.approx(want) and np.allclose(shrunk, want * target + (1 - want) * s)


def test_noise_edge_and_density(spark):
    assert pf.marchenko_pastur_bounds(100, 100) == pytest.approx((0, 4))
    low, high = pf.marchenko_pastur_bounds(50, 200)
    grid = np.linspace(0, high + 1, 4001)
    df = spark.createDataFrame([(float(v),) for v in grid], "x double")
    pdf = np.array([r.p for r in df.select("x", pf.marchenko_pastur_pdf("x", 50, 200).alias("p")).orderBy("x").collect()])
    assert pdf[(grid < low) | (grid > high)].max() == 0 and np.trapezoid(pdf, grid) == pytest.approx(1, abs=2e-3)


def test_denoising_and_shrinkage_lower_risk(spark):
    wins = {"denoised": 0, "shrunk": 0}
    for seed in range(5):
        days, loadings, truth = sm.simulate_factor_returns(spark, 40, 80, seed=seed)
        data = pf.cross_products(days)
        risk = lambda c: (w := pf.minimum_variance_weights(c)) @ truth @ w
        raw = risk(data.covariance())
        wins["denoised"] += risk(pf.denoise_covariance(data.covariance(), 80)) < raw
        wins["shrunk"] += risk(pf.ledoit_wolf(data)[0]) < raw
    assert min(wins.values()) >= 4
    values, vec = pf.eigen_descending(data.covariance())
    assert (np.diff(values) <= 0).all() and pf.explained_variance_ratio(values).sum() == pytest.approx(1)
    assert abs(vec[:, 0] @ loadings[:, 0]) / np.linalg.norm(loadings[:, 0]) > 0.9
    clean = pf.denoise_covariance(data.covariance(), 80)
    assert np.allclose(np.diag(clean), np.diag(data.covariance()))


def test_closed_form_weights():
    cov = np.diag([1.0, 2.0, 4.0])
    assert np.allclose(pf.minimum_variance_weights(cov), np.array([4, 2, 1]) / 7)
    assert np.allclose(pf.mean_variance_weights(2 * np.eye(4), np.arange(4.0), 5), np.arange(4) / 10)


def test_quantile_weights_and_variance(spark):
    s = np.random.default_rng(5).permutation(23).astype(float)
    df = spark.createDataFrame([(d, f"a{k:02}", float(v) * (1 if d else -1)) for d in (0, 1) for k, v in enumerate(s)], "d int, asset string, s double")
    got = pf.quantile_long_short(df, "s", ["d"], "asset").toPandas()
    for d, part in got.groupby("d"):
        part = part.sort_values("asset").reset_index(drop=True)
        bucket = pd.qcut(part["s"].rank(method="first"), 5, labels=False)
        want = np.where(bucket == 4, 0.5 / (bucket == 4).sum(), np.where(bucket == 0, -0.5 / (bucket == 0).sum(), 0))
        assert np.allclose(part["weight"], want) and part["weight"].sum() == pytest.approx(0)
    cov = np.cov(np.random.default_rng(6).normal(size=(40, 3)).T)
    w = spark.createDataFrame([("x", 0, 0.2), ("x", 1, 0.3), ("x", 2, -0.5)], "k string, asset long, weight double")
    out = pf.realized_variance(w, pf.matrix_frame(spark, cov), ["k"]).first()
    v = np.array([0.2, 0.3, -0.5])
    assert out.variance == pytest.approx(v @ cov @ v)
    assert w.agg(pf.cosine("weight", "weight").alias("c")).first().c == pytest.approx(1)


def test_market(spark):
    df = sm.simulate_market(spark, 400, seed=3, n_series=2)
    p = df.toPandas()
    assert len(p) == 800 and set(p["regime"]) <= {0, 1, 2} and (p["price"] > 0).all()
    one = p[p["series_id"] == "SIM0"].sort_values("date")
    assert np.allclose(one["price"], 100 * np.exp(one["return"].cumsum()))
    assert list(pd.to_datetime(one["date"])) == list(pd.bdate_range("2016-01-01", periods=400))
    again = sm.simulate_market(spark, 400, seed=3, n_series=1).toPandas().sort_values("date")
    assert np.array_equal(again["return"].to_numpy(), one["return"].to_numpy())
    assert not np.array_equal(p[p["series_id"] == "SIM1"]["return"].to_numpy(), one["return"].to_numpy())
    calm, wild = p[p["regime"] == 0]["return"].std(), p[p["regime"] == 2]["return"].std()
    assert wild > calm


def test_gbm_schemes_and_order(spark):
    mu, sigma, T, fine = 0.1, 0.4, 1.0, 512
    noise = sm.brownian_increments(spark, T, fine, 60, seed=0).persist()
    end = noise.groupBy("path_id").agg(F.sum("dw").alias("w")).select("path_id", sm.gbm_exact(mu, sigma, 1.0, F.lit(T), "w").alias("x0"))
    errors = {}
    for scheme in ("euler", "milstein"):
        for n in (16, 64):
            coarse = noise.groupBy("path_id", (F.floor((F.col("step") - 1) / (fine // n)) + 1).cast("int").alias("step")).agg(F.sum("dw").alias("dw"))
            last = sm.simulate_gbm(spark, mu, sigma, 1.0, T, n, scheme=scheme, increments=coarse).where(f"step = {n}")
            errors[scheme, n] = last.join(end, "path_id").agg(F.avg(F.abs(F.col("x") - F.col("x0"))).alias("e")).first().e
    slope = lambda s: np.log(errors[s, 16] / errors[s, 64]) / np.log(4)
    assert 0.3 < slope("euler") < 0.75 and 0.75 < slope("milstein") < 1.3
    path = sm.simulate_gbm(spark, mu, sigma, 2.0, T, 8, seed=1).orderBy("step").collect()
    assert len(path) == 9 and path[0].x == 2.0 and path[-1].t == pytest.approx(T)
    with pytest.raises(ValueError):
        sm.simulate_gbm(spark, mu, sigma, 1.0, T, 4, scheme="heun")


def test_ou(spark):
    end = sm.simulate_ou(spark, 2.0, 1.0, 0.6, 1.0, 4.0, 2, seed=1, n_paths=4000).where("step = 2").agg(F.var_samp("x").alias("v"), F.avg("x").alias("m")).first()
    assert end.v == pytest.approx(sm.ou_stationary_variance(2.0, 0.6), rel=0.1) and end.m == pytest.approx(1.0, abs=0.03)
    rough = sm.simulate_ou(spark, 2.0, 1.0, 0.6, 1.0, 8.0, 10, seed=1, scheme="euler", n_paths=4000).where("step = 10").agg(F.var_samp("x").alias("v")).first()
    assert rough.v > 1.5 * sm.ou_stationary_variance(2.0, 0.6)
    fit = sm.estimate_ou(sm.simulate_ou(spark, 3.0, 1.0, 0.5, 0.5, 400.0, 20000, seed=2), "x", 0.02).first()
    assert fit.kappa == pytest.approx(3, rel=0.15) and fit.theta == pytest.approx(1, abs=0.05) and fit.sigma == pytest.approx(0.5, rel=0.05)
    with pytest.raises(ValueError):
        sm.simulate_ou(spark, 1, 1, 1, 1, 1, 2, scheme="x")


def test_heston_and_merton(spark):
    h = sm.simulate_heston(spark, 0.05, 2.0, 0.04, 0.3, -0.7, 100.0, 0.04, 1.0, 50, seed=1, n_paths=20).toPandas()
    assert (h["price"] > 0).all() and (h["variance"] >= 0).all() and len(h) == 20 * 51
    assert sm.feller_condition(2.0, 0.04, 0.3) and not sm.feller_condition(0.5, 0.04, 0.5)
    m = sm.simulate_merton(spark, 0.0, 0.1, 5.0, -0.1, 0.2, 100.0, 1.0, 250, seed=2, n_paths=400).toPandas()
    assert m[m["step"] == 0]["jumps"].sum() == 0 and m.groupby("path_id")["jumps"].sum().mean() == pytest.approx(5, rel=0.15)
    r = np.log(m["price"]).groupby(m["path_id"]).diff().dropna()
    assert r.kurt() > 3 and m[m["step"] == 250]["price"].mean() == pytest.approx(100, rel=0.1)


def test_ctmc_occupancy(spark):
    q = sm.generator_of(sm.TRANSITION)
    assert np.allclose(q.sum(axis=1), 0)
    held = sm.occupancy(sm.simulate_ctmc(spark, q, 4000.0, 0, seed=3, n_paths=8), 4000.0).groupBy("state").agg((F.sum("time") / 32000).alias("share")).collect()
    from tidemark.operators.regimes import stationary_distribution

    pi = stationary_distribution(sm.TRANSITION)
    assert sum(r.share for r in held) == pytest.approx(1) and all(abs(r.share - pi[r.state]) < 0.05 for r in held)
    stuck = sm.simulate_ctmc(spark, np.zeros((2, 2)), 10.0, 1, seed=0).collect()
    assert [(r.jump_time, r.state) for r in stuck] == [(0.0, 1)]
