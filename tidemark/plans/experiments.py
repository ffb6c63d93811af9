"""End-to-end experiments. Each takes frames and parameters and returns named DataFrames; showing them is left to the caller."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import schema, ts
from tidemark.operators import backtest as bt
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import models, portfolio, regimes, simulate
from tidemark.operators import statistics as st


class Frames(dict[str, DataFrame]):
    """Named frames. Some inputs are kept in memory for them; ``release`` gives those back once the frames were used."""

    def __init__(self, frames: dict[str, DataFrame], *held: DataFrame):
        super().__init__(frames)
        self.held = held

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _tagged(name: str, df: DataFrame, column: str = "strategy") -> DataFrame:
    return df.select(F.lit(name).alias(column), "*")


def baseline_research(market: DataFrame, min_train: int = models.MIN_TRAIN, test: int = models.TEST, threshold: float = 0.54, cost: float = 0.0002) -> Frames:
    """Features, both candidate models, the better one, its backtest."""
    frame = ft.build_features(market).persist()
    names = schema.feature_columns(frame)
    results = [models.walk_forward_validate(frame, names, name, make, min_train, test) for name, make in models.candidate_models().items()]
    best = models.choose_best(results)
    ledger = bt.run_backtest(best.predictions, threshold, cost)
    made = {
        "validation": _union([r.metrics for r in results]), "predictions": best.predictions, "ledger": ledger,
        "metrics": _tagged(best.name, bt.backtest_metrics(ledger), "model"), "features": frame,
    }
    return Frames(made, frame, *[r.predictions for r in results])


def regime_research(market: DataFrame, min_train: int = models.MIN_TRAIN, test: int = models.TEST, n_states: int = 3) -> Frames:
    """Regime recovery, and the logistic model plain, with regime features, and fitted by regime.

    The model with regime features is scored on the rows that have posteriors, after a warm-up of its own.
    """
    found = regimes.detect_regimes(market, n_states)
    frame = ft.build_features(market.drop("regime")).persist()
    names = schema.feature_columns(frame)
    posteriors = regimes.walk_forward_posteriors(frame, min_train, test, n_states).drop("fold")
    rich = frame.join(posteriors, ["series_id", "date"])
    predictions = {
        "baseline": models.walk_forward_predictions(frame, names, models.Logistic, min_train, test),
        "with_regime_features": models.walk_forward_predictions(rich, names + schema.regime_columns(posteriors), models.Logistic, min_train, test),
        "conditioned": models.regime_conditioned_predictions(frame, names, models.Logistic, min_train, test, n_states),
    }
    predictions = {k: v.persist() for k, v in predictions.items()}
    made = {
        **found, "validation": _union([models.validate(k, v).metrics for k, v in predictions.items()]),
        "metrics": _union([_tagged(k, bt.backtest_metrics(bt.run_backtest(v)), "model") for k, v in predictions.items()]),
    }
    return Frames(made, frame, *predictions.values())


def alpha_research(market: DataFrame, min_train: int = models.MIN_TRAIN, test: int = models.TEST, n_states: int = 3, cost: float = 0.0002) -> Frames:
    """Six signals: reports, correlations before and after orthogonalisation, and three combinations' coefficients."""
    base = market.select("series_id", "date", "price", "return")
    posteriors = regimes.walk_forward_posteriors(base, min_train, test, n_states)
    regime_signal = ft.regime_transition_signal(posteriors).select("series_id", "date", "alpha_regime_transition")
    frame = ft.mean_reversion_signal(base)
    for lookback in (20, 60):
        frame = ft.momentum_signal(frame, lookback, out=f"alpha_momentum_{lookback}")
    frame = ft.placebo_signal(ft.vol_managed_signal(frame)).withColumn("fwd", F.lead("return", 1).over(ts.spec()))
    frame = frame.join(regime_signal, ["series_id", "date"], "left").persist()
    signals = [c for c in frame.columns if c.startswith("alpha_")]
    long = ft.to_long(frame, signals, ["series_id", "date", "price", "fwd"])
    independent = ev.orthogonalize(frame, signals)
    made = {
        "equal_weight": ev.combine_equal_weight(frame, signals), "ic_weighted": ev.combine_ic_weighted(frame, signals), "ridge": ev.combine_ridge(frame, signals),
    }
    combined = _union([df.select("series_id", F.lit(name).alias("signal"), F.col("combined").alias("value"), "fwd") for name, df in made.items()])
    reports = {
        "report": ev.alpha_report(long, cost), "correlation": ev.signal_correlation(frame.dropna(subset=signals), signals),
        "orthogonal_correlation": ev.signal_correlation(independent, signals), "combined_ic": ev.information_coefficient(combined),
    }
    return Frames(reports, frame)


def statistical_rigor(market: DataFrame, replicates: int = 1000, mean_block: float = 20.0, min_train: int = models.MIN_TRAIN, test: int = models.TEST, embargoes=(0, 10, 30)) -> Frames:
    """The chosen strategy against baselines, bootstrap intervals and p-value, embargo sweep, deflated Sharpe ratio over six trials."""
    base = baseline_research(market, min_train, test)
    predictions, ledger = base["predictions"], base["ledger"].persist()
    compared = {"strategy": ledger, "buy_and_hold": bt.buy_and_hold(predictions), "random_signal": bt.random_signal(predictions)}
    statistics = {"sharpe": st.sharpe_of, "total_return": st.total_return_of}
    intervals = [_tagged(k, st.block_bootstrap_ci(ledger, "strategy_return", f, replicates, mean_block), "statistic") for k, f in statistics.items()]
    names = schema.feature_columns(base["features"])
    swept = [models.validate(f"embargo_{e}", models.walk_forward_predictions(base["features"], names, models.Logistic, min_train, test, e)).metrics for e in embargoes]
    thresholds = [0.50, 0.52, 0.54, 0.56, 0.58, 0.60]
    grid = bt.grid_backtest(predictions, thresholds, [0.0002])
    # Six numbers: the per-period Sharpe ratios of the trials.
    trials = [r["annualised_sharpe"] / np.sqrt(ev.PERIODS) for r in grid.groupBy("threshold").agg(F.avg("annualised_sharpe").alias("annualised_sharpe")).collect()]
    made = {
        "metrics": _union([_tagged(k, bt.backtest_metrics(v)) for k, v in compared.items()]), "intervals": _union(intervals),
        "p_value": st.bootstrap_p_value(ledger, "strategy_return", replicates=replicates, mean_block=mean_block), "embargo": _union(swept), "trials": grid,
        "deflated": st.deflated_sharpe_ratio(ledger, "strategy_return", trials),
    }
    return Frames(made, ledger, *base.held)


def portfolio_research(spark: SparkSession, n_assets: int = 40, n_days: int = 150, seed: int = 0) -> Frames:
    """Four covariances of one simulated panel: risk of their minimum-variance weights, and size and risk of mean-variance weights on pure noise."""
    days, loadings, truth = simulate.simulate_factor_returns(spark, n_assets, n_days, seed=seed)
    data = portfolio.cross_products(days)
    sample = data.covariance()
    shrunk, delta = portfolio.ledoit_wolf(data)
    found = {"true": truth, "sample": sample, "denoised": portfolio.denoise_covariance(sample, data.n_obs), "shrunk": shrunk}
    noise = np.random.default_rng(seed + 1).normal(0, 0.001, n_assets)
    rows = []
    for name, cov in found.items():
        w, m = portfolio.minimum_variance_weights(cov), portfolio.mean_variance_weights(cov, noise)
        rows.append((name, float(w @ truth @ w), float(abs(w).sum()), float(abs(m).sum()), float(m @ truth @ m), float(delta) if name == "shrunk" else None))
    values, vectors = portfolio.eigen_descending(data.correlation())
    share = portfolio.explained_variance_ratio(values)
    edge = portfolio.marchenko_pastur_bounds(n_assets, n_days)[1]
    first = portfolio.eigen_descending(sample)[1][:, 0]
    cosine = abs(first @ loadings[:, 0]) / np.linalg.norm(loadings[:, 0])
    section = days.where("t = 0").select(F.lit(0).alias("t"), F.posexplode("x").alias("asset", "signal"))
    made = {
        "risk": spark.createDataFrame(rows, "covariance string, min_variance double, min_variance_gross double, mean_variance_gross double, mean_variance double, delta double"),
        "scree": spark.createDataFrame([(k, float(v), float(s), bool(v > edge)) for k, (v, s) in enumerate(zip(values, share, strict=True))], "k int, eigenvalue double, share double, signal boolean"),
        "market_factor": spark.createDataFrame([(float(cosine), float(edge))], "cosine double, noise_edge double"),
        "long_short": portfolio.quantile_long_short(section, "signal", ["t"], "asset"),
    }
    return Frames(made)


def real_data_research(panel: DataFrame, least_rows: int = 1000, thresholds=(0.50, 0.52, 0.54, 0.56, 0.58), costs=(0.0, 0.0002, 0.0005, 0.001), lookbacks=(5, 10, 20, 60, 120, 250)) -> Frames:
    """Every series of a panel at once: validation, threshold and cost grid, lookback and cost grid, sizing. Series under ``least_rows`` rows are left out and listed."""
    counts = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    long_enough = panel.join(counts.where(F.col("rows") >= least_rows).select("series_id"), "series_id", "left_semi")
    frame = ft.build_features(long_enough)
    predictions = models.walk_forward_predictions(frame, schema.feature_columns(frame), models.Logistic).persist()
    sized = {"binary": bt.run_backtest(predictions), "vol_target": bt.run_vol_targeted_backtest(predictions)}
    shared = ["series_id", "total_return", "annualised_sharpe", "max_drawdown", "mean_turnover", "active_days"]
    edge = predictions.select("series_id", bt.edge_return().alias("e"))
    made = {
        "skipped": counts.where(F.col("rows") < least_rows), "validation": models.validate("logistic_regression", predictions).metrics,
        "threshold_grid": bt.grid_backtest(predictions, list(thresholds), list(costs)),
        "lookback_grid": bt.lookback_grid(long_enough, list(lookbacks), list(costs[:3])),
        "sizing": _union([_tagged(k, bt.backtest_metrics(v).select(*shared), "sizing") for k, v in sized.items()]),
        "kelly": edge.groupBy("series_id").agg(bt.kelly_fraction("e").alias("kelly"), bt.fractional_kelly("e").alias("half_kelly")),
    }
    return Frames(made, predictions)


def figure_data(spark: SparkSession, market: DataFrame, min_train: int = models.MIN_TRAIN, test: int = models.TEST) -> Frames:
    """What four charts show: equity curves, regime spans over the price, the cost heat map, the scree plot."""
    base = baseline_research(market, min_train, test)
    curves = {"strategy": base["ledger"], "buy_and_hold": bt.buy_and_hold(base["predictions"]), "random_signal": bt.random_signal(base["predictions"])}
    made = {
        "equity_curves": _union([_tagged(k, v.select("series_id", "date", "equity")) for k, v in curves.items()]),
        "regime_spans": ts.runs(market, "regime") if "regime" in market.columns else ts.runs(regimes.infer_states(market), "state"),
        "cost_heatmap": bt.grid_backtest(base["predictions"], [0.50, 0.52, 0.54, 0.56, 0.58], [0.0, 0.0002, 0.0005, 0.001]).select("series_id", "threshold", "cost", "annualised_sharpe"),
        "scree": portfolio_research(spark)["scree"],
    }
    return Frames(made, *base.held)


def dashboard_run(spark: SparkSession, n_days: int = 2500, seed: int = 7, threshold: float = 0.54, cost: float = 0.0002) -> Frames:
    """The interactive run: four parameters, results kept for further looks. The last 100 ledger rows are a top-k."""
    market = simulate.simulate_market(spark, n_days, seed).persist()
    base = baseline_research(market.drop("regime"), threshold=threshold, cost=cost)
    found = regimes.detect_regimes(market)
    made = {
        **{k: base[k] for k in ("validation", "metrics", "ledger")}, "recent": base["ledger"].orderBy(F.desc("date")).limit(100),
        "regime_counts": market.groupBy("regime").count(), "regime_scores": found["scores"], "confusion": found["confusion"],
    }
    return Frames(made, market, *base.held)
