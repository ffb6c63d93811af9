"""Cost-aware backtests, sizing and baselines as stacked windows over one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators.evaluate import PERIODS, sharpe


def direction(probability: Column | str, threshold: Column | float) -> Column:
    """-1, 0 or 1. Where both bounds are met (0.5 at threshold 0.5) the short side wins. Thresholds are binary doubles."""
    p, up = ts.as_col(probability), threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(p <= F.lit(1.0) - up, -1).when(p >= up, 1).otherwise(0)


def _ledger(df: DataFrame, cost: Column | float, by, order: str) -> DataFrame:
    """Adds turnover, strategy_return, equity and drawdown to a frame with ``position``."""
    w = ts.spec(by, order)
    fee = cost if isinstance(cost, Column) else F.lit(float(cost))
    out = df.withColumn("turnover", ts.diff_abs_or_self("position", w))
    out = out.withColumn("strategy_return", F.col("position") * F.col("next_return") - F.col("turnover") * fee)
    out = out.withColumn("equity", ts.cumulative(F.product, F.lit(1.0) + F.col("strategy_return"), w))
    return out.withColumn("drawdown", ts.ratio("equity", running_peak("equity", by, order)) - 1.0)


def run_backtest(predictions: DataFrame, entry_threshold: Column | float = 0.54, transaction_cost: Column | float = 0.0002, by=ts.KEYS, order: str = "date") -> DataFrame:
    """The ledger: position (int), turnover, strategy_return, equity, drawdown beside the columns of ``predictions`` (probability, next_return)."""
    return _ledger(predictions.withColumn("position", direction("probability", entry_threshold).cast("int")), transaction_cost, by, order)


def backtest_metrics(ledger: DataFrame, by=ts.KEYS, order: str = "date") -> DataFrame:
    """total_return, annualised_sharpe, max_drawdown, mean_turnover, active_days, and mean_gross_leverage where positions are sized."""
    sized = "direction" in ledger.columns
    active = "direction" if sized else "position"
    made = [
        (F.max_by("equity", order) - 1.0).alias("total_return"), sharpe("strategy_return").alias("annualised_sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.col("turnover").cast("double")).alias("mean_turnover"), F.avg((F.col(active) != 0).cast("double")).alias("active_days"),
    ]
    return ledger.groupBy(*by).agg(*made, *([F.avg(F.abs("position")).alias("mean_gross_leverage")] if sized else []))


def vol_target_scale(vol: Column | str, target_vol: float, max_leverage: float = 3.0) -> Column:
    """target / vol up to the cap; 0 where vol is null or zero."""
    raw = ts.ratio(F.lit(float(target_vol)), vol)
    return F.when(raw.isNull(), F.lit(0.0)).otherwise(F.least(raw, F.lit(float(max_leverage))))


def run_vol_targeted_backtest(
    predictions: DataFrame, entry_threshold: float = 0.54, transaction_cost: float = 0.0002, target_vol: float = 0.01, vol_window: int = 20, max_leverage: float = 3.0,
    by=ts.KEYS, order: str = "date",
) -> DataFrame:
    """The ledger with positions scaled to a constant volatility, estimated from returns known before the row."""
    vol = ts.rolling(F.stddev_samp, "next_return", vol_window, vol_window, ts.spec(by, order), shift=1)
    out = predictions.withColumn("direction", direction("probability", entry_threshold).cast("int")).withColumn("realized_vol", vol)
    out = out.withColumn("position", F.col("direction") * vol_target_scale("realized_vol", target_vol, max_leverage))
    return _ledger(out, transaction_cost, by, order)


def grid_backtest(predictions: DataFrame, thresholds: list[float], costs: list[float], by=ts.KEYS, order: str = "date") -> DataFrame:
    """Metrics of every threshold and cost: the grid multiplies the rows and is part of the window key, so cells run in parallel."""
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(c)).alias("cost")) for t in thresholds for c in costs])
    cells = predictions.select(*by, order, "probability", "next_return", F.explode(grid).alias("_g")).select(*by, order, "probability", "next_return", "_g.threshold", "_g.cost")
    keys = [*by, "threshold", "cost"]
    return backtest_metrics(run_backtest(cells, F.col("threshold"), F.col("cost"), keys, order), keys, order)


def lookback_grid(series: DataFrame, lookbacks: list[int], costs: list[float], by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, lookback, cost, n, sharpe of following the sign of each lookback's price change. All lookbacks share one sort; cells are part of the key."""
    w = ts.spec(by, order)
    wide = series.select(*by, order, F.lead("return", 1).over(w).alias("next_return"), *[ts.pct_change("price", k, w).alias(f"_m{k}") for k in lookbacks])
    cells = F.array(*[F.struct(F.lit(k).alias("lookback"), F.signum(f"_m{k}").alias("position"), F.lit(float(c)).alias("cost")) for k in lookbacks for c in costs])
    grown = wide.select(*by, order, "next_return", F.explode(cells).alias("_c")).select(*by, order, "next_return", "_c.*").where("position is not null and next_return is not null")
    keys = [*by, "lookback", "cost"]
    net = F.col("position") * F.col("next_return") - ts.diff_abs_or_self("position", ts.spec(keys, order)) * F.col("cost")
    return grown.select(*keys, net.alias("_r")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sharpe("_r").alias("sharpe"))


def running_peak(value: Column | str, by=ts.KEYS, order: str = "date") -> Column:
    """Window form: the largest value so far."""
    return ts.cumulative(F.max, value, ts.spec(by, order))


def buy_and_hold(predictions: DataFrame, transaction_cost: float = 0.0002, by=ts.KEYS, order: str = "date") -> DataFrame:
    """Ledger of a constant long position: one entry cost."""
    return run_backtest(predictions.withColumn("probability", F.lit(1.0)), 0.5, transaction_cost, by, order)


def random_signal(predictions: DataFrame, transaction_cost: float = 0.0002, seed: int = 0, by=ts.KEYS, order: str = "date") -> DataFrame:
    """Ledger of uniform probabilities, drawn by a hash of seed and row key."""
    return run_backtest(predictions.withColumn("probability", ts.uniform(0, seed, *by, order)), transaction_cost=transaction_cost, by=by, order=order)


# --- aggregates -------------------------------------------------------------


def kelly_fraction(r: Column | str) -> Column:
    """Aggregate: mean over sample variance, 0 where that is 0."""
    return F.when(F.var_samp(r) == 0, F.lit(0.0)).otherwise(F.avg(r) / F.var_samp(r))


def fractional_kelly(r: Column | str, fraction: float = 0.5) -> Column:
    return F.lit(float(fraction)) * kelly_fraction(r)


def annualized_sharpe(r: Column | str, periods: int = PERIODS) -> Column:
    """Aggregate by population deviation."""
    return sharpe(r, 0, periods)


def edge_return(probability: str = "probability", next_return: str = "next_return") -> Column:
    """Return of betting on the sign of the edge."""
    return F.signum(F.col(probability) - 0.5) * F.col(next_return)


def total_return(r: Column | str) -> Column:
    """Aggregate: compounded return."""
    return F.product(F.lit(1.0) + ts.as_col(r)) - 1.0
