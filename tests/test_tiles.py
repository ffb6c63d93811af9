"""Tiled covariances and leading eigenpairs against dense NumPy."""

import numpy as np
import pytest

from tidemark.operators import portfolio, tiles


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    return rng.normal(size=(210, 23)) @ rng.normal(size=(23, 23)) + 5


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = [(x.tolist(),) for x in data]
    return spark.createDataFrame([*rows, ([None] * 23,), (None,)], "x array<double>")


@pytest.fixture(scope="module")
def panel(spark, data):
    return spark.createDataFrame([(t, f"a{k:02}", float(v)) for t, x in enumerate(data) for k, v in enumerate(x)], "t int, asset string, r double")


def dense(frame, value="cov"):
    rows = frame.toPandas()
    codes = sorted(set(rows["i"]))
    out = np.full((len(codes),) * 2, np.nan)
    out[rows["i"].map(codes.index), rows["j"].map(codes.index)] = rows[value]
    assert len(rows) == out.size
    return out


@pytest.mark.parametrize(("width", "chunk_rows"), [(5, 40), (256, 8192), (23, 1)])
def test_covariance_by_tiles(vectors, data, width, chunk_rows):
    if chunk_rows == 1:
        vectors, data = vectors.limit(12), data[:12]
    assert dense(tiles.array_covariance(vectors, width=width, chunk_rows=chunk_rows)) == pytest.approx(np.cov(data.T), abs=1e-10)


def test_panel_tiles(panel, data):
    cov = tiles.panel_covariance(panel, width=7, chunk_rows=50)
    assert dense(cov) == pytest.approx(np.cov(data.T), abs=1e-10)
    assert dense(tiles.correlation(cov), "rho") == pytest.approx(np.corrcoef(data.T), abs=1e-10)


def test_shrinkage(panel):
    shrunk, law = tiles.ledoit_wolf(panel, width=7, chunk_rows=50)
    want, delta = portfolio.ledoit_wolf(portfolio.panel_cross(panel)[1])
    assert law.first()["delta"] == pytest.approx(delta, abs=1e-12) and law.first()["n_obs"] == 210
    assert dense(shrunk) == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize(("k", "extra"), [(1, 0), (4, 3), (23, 0), (40, 5)])
def test_leading_eigenpairs(vectors, data, k, extra):
    for of_correlation, matrix in ((False, np.cov(data.T)), (True, np.corrcoef(data.T))):
        values, loadings, trace = tiles.leading_eigenpairs(vectors, k, of_correlation=of_correlation, extra=extra)
        want = np.linalg.eigvalsh(matrix)[::-1][:k]
        assert values == pytest.approx(want, abs=1e-8 * want[0])
        assert trace == pytest.approx(np.trace(matrix))
        assert loadings.T @ loadings == pytest.approx(np.eye(len(values)), abs=1e-9)


def test_few_rows_and_constant_columns(spark):
    rows = [([float(k), 2.0 * k, 7.0],) for k in range(4)]
    values, _, _ = tiles.leading_eigenpairs(spark.createDataFrame(rows, "x array<double>"), 3)
    assert values == pytest.approx([25 / 3, 0, 0], abs=1e-12)


def test_what_is_no_panel(spark, panel):
    with pytest.raises(ValueError, match="all assets"):
        tiles.panel_covariance(panel.where("not (t = 3 and asset = 'a01')"))
    with pytest.raises(ValueError, match="observations"):
        tiles.panel_covariance(panel.limit(0))
    with pytest.raises(ValueError, match="numbers of columns"):
        tiles.array_covariance(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"))
    with pytest.raises(ValueError, match="observations"):
        tiles.leading_eigenpairs(spark.createDataFrame([], "x array<double>"), 1)
