"""Regime inference, folds, classifiers and validation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import schema
from tidemark.operators import features as ft
from tidemark.operators import folds, models, regimes, simulate


@pytest.fixture(scope="module")
def sim(spark):
    return simulate.simulate_market(spark, 1200, seed=7).persist()


def test_stationary_distribution():
    pi = regimes.stationary_distribution(simulate.TRANSITION)
    assert pi.sum() == pytest.approx(1) and np.allclose(pi @ simulate.TRANSITION, pi)


def test_filter_beats_chance_and_sums_to_one(spark, sim):
    got = regimes.hamilton_filter(sim, simulate.TRANSITION, simulate.DRIFT, simulate.VOLATILITY).join(sim.select("date", "regime"), "date").toPandas().sort_values("date")
    p = np.stack(got["probabilities"].to_list())
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (p.argmax(axis=1) == got["regime"]).mean() > 0.55
    _, total = regimes.filter_states(sim.toPandas().sort_values("date")["return"].to_numpy(), simulate.TRANSITION, simulate.DRIFT, simulate.VOLATILITY)
    assert got["log_likelihood"].iloc[-1] == pytest.approx(total)


def brute_smooth(like, start, transition):
    n, k = like.shape
    f, b = np.zeros((n, k)), np.ones((n, k))
    f[0] = start * like[0]
    for t in range(1, n):
        f[t] = (f[t - 1] @ transition) * like[t]
    for t in range(n - 2, -1, -1):
        b[t] = transition @ (like[t + 1] * b[t + 1])
    p = f * b
    return p / p.sum(axis=1, keepdims=True), np.log(f[-1].sum())


def test_smoothing_equals_forward_backward():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 17):
        like = rng.random((n, 3)) + 0.1
        start = np.array([0.5, 0.3, 0.2])
        posterior, moves, total = regimes.smooth(like, start, simulate.TRANSITION)
        want, log = brute_smooth(like, start, simulate.TRANSITION)
        assert np.allclose(posterior, want) and total == pytest.approx(log)
        assert moves.sum() == pytest.approx(n - 1)


def test_hmm_recovers_regimes(spark, sim):
    found = regimes.detect_regimes(sim)
    scores = found["scores"].first()
    assert scores.accuracy > 0.5 and 0 <= scores.mean_lag <= 30
    states = found["states"].toPandas()
    assert np.allclose(np.stack(states["posterior"].to_list()).sum(axis=1), 1)
    assert (np.stack(states["posterior"].to_list()).argmax(axis=1) == states["aligned"]).all()
    counts = found["confusion"].toPandas()
    assert counts.loc[counts["true"] == counts["predicted"], "n"].sum() / counts["n"].sum() == pytest.approx(scores.accuracy)
    params = regimes.hmm_parameters(sim).toPandas().sort_values("state")
    assert params["mean"].is_monotonic_increasing and all(abs(sum(t) - 1) < 1e-9 for t in params["transition"])


def test_align_states():
    assert regimes.align_states(np.array([[0, 9, 1], [8, 0, 0], [1, 1, 7]])) == {0: 1, 1: 0, 2: 2}


def test_detection_lag_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    true = np.repeat(rng.integers(0, 3, 20), 12)
    seen = np.roll(true, 4)
    seen[100:160] = 0
    df = spark.createDataFrame([("A", k, int(a), int(b)) for k, (a, b) in enumerate(zip(true, seen, strict=True))], "series_id string, date int, regime int, aligned int")
    lags = []
    for c in np.flatnonzero(np.diff(true)) + 1:
        hit = np.flatnonzero(seen[c : c + 30] == true[c])
        lags.append(hit[0] if hit.size else 30)
    got = regimes.detection_lag(df).first()
    assert got.changes == len(lags) and got.mean_lag == pytest.approx(np.mean(lags))


def test_posteriors_do_not_look_ahead(spark, sim):
    base = sim.select("series_id", "date", "return").toPandas().sort_values("date").reset_index(drop=True)
    shocked = base.copy()
    shocked.loc[1000:, "return"] = 0.2
    kind = "series_id string, date date, return double"
    one, two = (regimes.walk_forward_posteriors(spark.createDataFrame(x, kind), 700, 150).toPandas().sort_values("date") for x in (base, shocked))
    before = one["date"] < base["date"][1000]
    names = schema.regime_columns(spark.createDataFrame(one.head(1)))
    assert before.sum() == 300 and np.allclose(one[before.to_numpy()][names], two[before.to_numpy()][names])
    assert np.allclose(one[names].sum(axis=1), 1)


@pytest.mark.parametrize("n, embargo", [(40, 0), (41, 3), (60, 5), (20, 0), (39, 30)])
def test_folds_equal_ranges(spark, n, embargo):
    min_train, test = 20, 10
    df = spark.createDataFrame([("A", k) for k in range(n)], "series_id string, date int")
    got = folds.expanding_rows(df, min_train, test, embargo).toPandas()
    starts = list(range(min_train, n - test, test))
    assert sorted(got["fold"].unique()) == list(range(len(starts))) and folds.fold_count(n, min_train, test) == len(starts)
    for f, s in enumerate(starts):
        part = got[got["fold"] == f]
        assert sorted(part.loc[part["is_test"], "row"]) == list(range(s, s + test))
        assert sorted(part.loc[~part["is_test"], "row"]) == list(range(max(0, s - embargo)))
    table = folds.fold_table(df, min_train, test, embargo).orderBy("fold").collect()
    assert [r.start for r in table] == starts and [r.train_rows for r in table] == [max(0, s - embargo) for s in starts]


def toy(n=600, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4))
    y = (X[:, 0] - 0.5 * X[:, 1] + (X[:, 2] > 0.3) * X[:, 0] + rng.logistic(size=n) > 0).astype(int)
    return X, y


def test_logistic_is_at_the_optimum():
    X, y = toy()
    m = models.Logistic().fit(X, y)
    a = np.column_stack((np.ones(len(X)), (X - X.mean(axis=0)) / X.std(axis=0)))
    p = 1 / (1 + np.exp(-a @ m.w))
    grad = 0.3 * a.T @ (p - y) + np.append(0, m.w[1:])
    assert abs(grad).max() < 1e-7


@pytest.mark.parametrize("make", [models.Logistic, models.Boosting])
def test_classifiers_beat_chance(make):
    X, y = toy(1200)
    p = make().fit(X[:800], y[:800]).predict_proba(X[800:])
    assert np.allclose(p.sum(axis=1), 1)
    rank = pd.Series(p[:, 1]).rank()
    pos = y[800:] == 1
    assert (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()) > 0.7
    assert make().fit(X[:, :1] * 0, y).predict_proba(X[:3, :1]).shape == (3, 2)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(4)
    s, y = rng.integers(0, 5, 300) / 5, rng.integers(0, 2, 300)
    df = spark.createDataFrame([("A", float(a), int(b)) for a, b in zip(s, y, strict=True)], "series_id string, probability double, target int")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert models.auc(df).first().auc == pytest.approx(want)
    assert models.auc(df.where("target = 1")).first().auc is None
    assert df.agg(models.accuracy().alias("a")).first().a == pytest.approx(((s >= 0.5) == y).mean())


def test_walk_forward(spark, sim):
    frame = ft.build_features(sim.drop("regime"))
    names = schema.feature_columns(frame)
    one = models.walk_forward_validate(frame, names, "logistic", models.Logistic, 800, 125)
    n = frame.count()
    assert one.predictions.count() == 125 * folds.fold_count(n, 800, 125)
    row = one.metrics.first()
    assert 0.3 < row.auc < 0.7 and 0.3 < row.accuracy < 0.7
    two = models.walk_forward_validate(frame, names, "boosting", models.Boosting, 800, 125)
    best = models.choose_best([one, two])
    assert best.metrics.first().auc == max(row.auc, two.metrics.first().auc)
    pooled = models.best_model(one.metrics.unionByName(two.metrics)).first()
    assert pooled.model == best.name
    with pytest.raises(ValueError):
        models.walk_forward_validate(frame, names, "short", models.Logistic, n, 125)
    with pytest.raises(ValueError):
        models.choose_best([])


def test_regime_conditioned(spark, sim):
    frame = ft.build_features(sim.drop("regime"))
    names = schema.feature_columns(frame)
    got = models.regime_conditioned_predictions(frame, names, models.Logistic, 800, 150)
    assert got.count() == 150 * folds.fold_count(frame.count(), 800, 150)
    assert got.where(~F.col("probability").between(0, 1)).count() == 0
    pooled = models.regime_conditioned_predictions(frame, names, models.Logistic, 800, 150, min_rows=10**6)
    plain = models.walk_forward_predictions(frame, names, models.Logistic, 800, 150)
    both = pooled.join(plain.select("date", F.col("probability").alias("q")), "date")
    assert both.where(F.abs(F.col("probability") - F.col("q")) > 1e-9).count() == 0
