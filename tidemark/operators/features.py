"""Leak-free features and signals as window expressions over one sort for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import schema, ts

LAGS, WINDOWS, ZSCORE_MIN = (1, 2, 3, 5, 10), (5, 10, 20, 60), 60


def build_features(data: DataFrame, by=ts.KEYS, order: str = "date", drop_incomplete: bool = True) -> DataFrame:
    """Adds 17 features, ``target`` (next return above 0) and ``next_return``; rows with a missing value go.

    Momentum and volatility use rows before the current one; drawdown compares
    the current price with the highest before it, so it may be positive.
    """
    schema.require(data, *by, order, "price", "return")
    w = ts.spec(by, order)
    made = {f"return_lag_{k}": F.lag("return", k).over(w) for k in LAGS}
    for n in WINDOWS:
        made[f"momentum_{n}"] = ts.ratio(F.lag("price", 1).over(w), F.lag("price", n + 1).over(w)) - 1.0
        made[f"volatility_{n}"] = ts.rolling(F.stddev_samp, "return", n, n, w, shift=1)
        made[f"drawdown_{n}"] = ts.ratio("price", ts.rolling(F.max, "price", n, n, w, shift=1)) - 1.0
    next_return = F.lead("return", 1).over(w)
    made["target"] = F.coalesce((next_return > 0).cast("int"), F.lit(0))
    made["next_return"] = next_return
    out = data.select("*", *[c.alias(name) for name, c in made.items()])
    return out.dropna(subset=[c for c in made if c != "target"]) if drop_incomplete else out


def _signal(frame: DataFrame, base, sign: float, zscore_window: int, out: str, by, order: str) -> DataFrame:
    """sign * trailing z-score of a base column, one row late. The base is a column first: window functions do not nest."""
    w = ts.spec(by, order)
    z = ts.zscore_trailing("_base", zscore_window, ZSCORE_MIN, w)
    return frame.withColumn("_base", base).withColumn(out, F.lit(sign) * z).drop("_base")


def mean_reversion_signal(frame: DataFrame, lookback: int = 5, zscore_window: int = 250, out: str = "alpha_mean_reversion", by=ts.KEYS, order: str = "date") -> DataFrame:
    return _signal(frame, ts.pct_change("price", lookback, ts.spec(by, order)), -1.0, zscore_window, out, by, order)


def momentum_signal(frame: DataFrame, lookback: int = 60, zscore_window: int = 250, out: str = "alpha_momentum", by=ts.KEYS, order: str = "date") -> DataFrame:
    return _signal(frame, ts.pct_change("price", lookback, ts.spec(by, order)), 1.0, zscore_window, out, by, order)


def vol_managed_signal(frame: DataFrame, vol_window: int = 20, zscore_window: int = 250, out: str = "alpha_vol_managed", by=ts.KEYS, order: str = "date") -> DataFrame:
    base = ts.rolling(F.stddev_samp, "return", vol_window, vol_window, ts.spec(by, order))
    return _signal(frame, base, -1.0, zscore_window, out, by, order)


def regime_transition_signal(posteriors: DataFrame, out: str = "alpha_regime_transition", by=ts.KEYS, order: str = "date") -> DataFrame:
    """Probability of the state with the highest mean less that of the lowest, one row late."""
    names = schema.regime_columns(posteriors)
    if len(names) < 2:
        raise ValueError("two or more regime_prob_ columns are needed")
    return posteriors.withColumn(out, F.lag(F.col(names[-1]) - F.col(names[0]), 1).over(ts.spec(by, order)))


def placebo_signal(frame: DataFrame, seed: int = 0, out: str = "alpha_placebo", by=ts.KEYS, order: str = "date") -> DataFrame:
    """Standard normal draws by a hash of seed and row key: independent of values, partitions and row order."""
    normal = F.sqrt(-2.0 * F.log(ts.uniform(0, seed, *by, order))) * F.cos(ts.uniform(1, seed, *by, order) * 6.283185307179586)
    return frame.withColumn(out, normal)


def to_long(frame: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    """One row for each signal: ``keep`` columns, signal, value."""
    return frame.unpivot(keep, signals, "signal", "value")
