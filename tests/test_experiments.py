"""End-to-end experiments on simulated markets."""

import pytest

from tidemark.operators import simulate
from tidemark.plans import experiments as ex


@pytest.fixture(scope="module")
def sim(spark):
    return simulate.simulate_market(spark, 1300, seed=7).persist()


def test_regime_research(spark, sim):
    out = ex.regime_research(sim, 400, 150)
    assert {r.model for r in out["metrics"].collect()} == {"baseline", "with_regime_features", "conditioned"}
    assert out["scores"].first().accuracy > 0.5


def test_alpha_research(spark, sim):
    out = ex.alpha_research(sim, test=200)
    assert out["report"].count() == 6
    assert {r.signal for r in out["combined_ic"].collect()} == {"equal_weight", "ic_weighted", "ridge"}
    off = [abs(r.rho) for r in out["orthogonal_correlation"].collect() if r.a != r.b and r.rho is not None]
    assert max(off) < 1e-6


def test_statistical_rigor(spark, sim):
    out = ex.statistical_rigor(sim.drop("regime"), replicates=60, embargoes=(0, 30))
    assert out["metrics"].count() == 3 and out["trials"].count() == 6
    assert all(r.lower <= r.upper for r in out["intervals"].collect())
    assert 0 <= out["deflated"].first().dsr <= 1 and 0 <= out["p_value"].first().p_value <= 1
    assert {r.model for r in out["embargo"].collect()} == {"embargo_0", "embargo_30"}


def test_portfolio_research(spark):
    out = ex.portfolio_research(spark)
    risk = {r.covariance: r.min_variance for r in out["risk"].collect()}
    assert risk["true"] <= min(risk["denoised"], risk["shrunk"]) and max(risk["denoised"], risk["shrunk"]) < risk["sample"]
    assert out["market_factor"].first().cosine > 0.95


def test_real_data_and_figures(spark, sim):
    short = sim.where("date < '2017-01-01'").selectExpr("'short' as series_id", "date", "price", "return")
    out = ex.real_data_research(sim.drop("regime").unionByName(short))
    assert [r.series_id for r in out["skipped"].collect()] == ["short"]
    assert out["threshold_grid"].count() == 20 and out["lookback_grid"].count() == 18 and out["sizing"].count() == 2 and out["kelly"].count() == 1
    figures = ex.figure_data(spark, sim)
    assert figures["equity_curves"].select("strategy").distinct().count() == 3 and figures["regime_spans"].count() > 10 and figures["cost_heatmap"].count() == 20


def test_dashboard(spark):
    out = ex.dashboard_run(spark, 1200)
    assert out["recent"].count() == 100 and out["regime_counts"].count() == 3
