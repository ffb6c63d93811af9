"""EM over blocks against the fit of one array."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import block_em, regimes

SCHEMA = "series_id string, date int, return double"


def series(n, seed):
    rng = np.random.default_rng(seed)
    calm = np.repeat(rng.integers(0, 2, -(-n // 25)), 25)[:n]
    return np.where(calm == 0, rng.normal(0.001, 0.01, n), rng.normal(-0.002, 0.04, n))


@pytest.mark.parametrize(("n_states", "block_rows", "rounds"), [(2, 40, 6), (3, 4, 3), (3, 10_000, 4), (1, 50, 2)])
def test_equal_to_the_single_fit(spark, n_states, block_rows, rounds):
    data = {"a": series(230, 1), "b": series(61, 2)}
    frame = pd.concat([pd.DataFrame({"series_id": k, "date": np.arange(v.size), "return": v}) for k, v in data.items()])
    rows = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", 900, None)], SCHEMA))
    got = {r.series_id: r for r in block_em.fit(rows, n_states, 3, block_rows=block_rows, rounds=rounds).collect()}
    assert got.keys() == data.keys()
    for k, v in data.items():
        want = regimes.fit_hmm(v, n_states, rounds=rounds, seed=3)
        for name in ("start", "means", "stds", "transition"):
            assert np.asarray(getattr(got[k], name)) == pytest.approx(want[name].ravel(), rel=1e-8, abs=1e-12)


def test_settled_series_keep_their_model(spark):
    """A loose tolerance settles series in different rounds."""
    data = {"a": series(150, 4), "flat": np.full(40, 0.01)}
    frame = pd.concat([pd.DataFrame({"series_id": k, "date": np.arange(v.size), "return": v}) for k, v in data.items()])
    got = {r.series_id: r for r in block_em.fit(spark.createDataFrame(frame), 2, block_rows=30, tol=0.05).collect()}
    for k, v in data.items():
        want = regimes.fit_hmm(v, 2, tol=0.05)
        assert np.asarray(got[k].means) == pytest.approx(want["means"], rel=1e-8, abs=1e-12)
        assert np.asarray(got[k].stds) == pytest.approx(want["stds"], rel=1e-6, abs=1e-9)


def test_few_rows_and_none(spark):
    assert block_em.fit(spark.createDataFrame([], SCHEMA), 2).count() == 0
    with pytest.raises(Exception, match="too few returns"):
        block_em.fit(spark.createDataFrame([("a", k, 0.1 * k) for k in range(3)], SCHEMA), 2).count()
