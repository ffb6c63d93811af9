"""Signal evaluation and combination on long frames: (keys, date, value, forward return).

Everything is partitioned by the keys (series and signal), so any number of
signals is evaluated by one plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks
from tidemark.sources import store

SIGNAL_KEYS = ("series_id", "signal")
PERIODS = 252


def information_coefficient(df: DataFrame, x: str = "value", y: str = "fwd", by=SIGNAL_KEYS, min_pairs: int = 10) -> DataFrame:
    """Spearman correlation by key: n, ic."""
    return ts.spearman(df, x, y, by, min_pairs)


def _centred_ranks(windows: np.ndarray) -> np.ndarray:
    """Twice the average ranks within each row, less their mean: how many values of the row lie below one, less how many lie above."""
    width = windows.shape[1]
    order = np.argsort(windows, axis=1, kind="stable")
    values = np.take_along_axis(windows, order, axis=1)
    place = np.broadcast_to(np.arange(width), values.shape)
    new = np.ones(values.shape, bool)
    new[:, 1:] = values[:, 1:] != values[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    ends = np.ones(values.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, place, width)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last + 1 - width).astype(float), axis=1)
    return out


def sliding_spearman(x: np.ndarray, y: np.ndarray, window: int, cells: int = 1 << 16) -> np.ndarray:
    """Spearman correlation of each window of consecutive pairs, NaN for a constant side.

    Only the first window of a lane is sorted; each further row changes the ranks
    that it and the row it replaces lie above or below, in one pass over the
    window. Ranks are whole numbers, so nothing drifts (their
    products sum exactly for windows of up to 200,000). A lane goes at least one
    window far, and the lanes, moved together, hold about ``cells`` numbers a side.
    """
    n = max(0, x.size - window + 1)
    out = np.full(n, np.nan)
    if not n:
        return out
    steps = max(window, -(-n * window // cells))
    starts = np.arange(0, n, steps)
    sides = []
    for v in (x, y):
        v = np.pad(v, (0, steps), "edge")
        held = v[starts[:, None] + np.arange(window)]
        sides.append((v, held, _centred_ranks(held)))
    a, b = sides[0][2], sides[1][2]
    for k in range(min(steps, n)):
        if k:
            slot = (k - 1) % window
            for v, held, ranks in sides:
                old, new = held[:, slot, None].copy(), v[starts + k + window - 1][:, None]
                held[:, slot] = new[:, 0]
                above = (held > new).view(np.int8) - (held < new).view(np.int8)
                ranks += above - (held > old).view(np.int8) + (held < old).view(np.int8)
                ranks[:, slot] = -above.sum(axis=1, dtype=np.int64)
        live = starts[starts + k < n]
        m = len(live)
        scale = np.sqrt(np.einsum("lw,lw->l", a[:m], a[:m]) * np.einsum("lw,lw->l", b[:m], b[:m]))
        rho = np.full(m, np.nan)
        np.divide(np.einsum("lw,lw->l", a[:m], b[:m]), scale, out=rho, where=scale > 0)
        out[live + k] = rho
    return out


def rolling_ic(df: DataFrame, window: int = 60, x: str = "value", y: str = "fwd", by=SIGNAL_KEYS, order: str = "date", native: bool = False, block_rows: int | None = None) -> DataFrame:
    """Trailing Spearman over complete windows of non-null pairs: keys, order, ic.

    A grouped function keeps up ranks over a key's own arrays, so that no window is
    gathered as a row or sorted again; with ``block_rows`` a long key is dealt to blocks, each with
    the ``window`` - 1 pairs before it. ``native`` gathers windows and ranks them in
    array functions.
    """
    pairs = df.where(ts.present(x, y))
    if native:
        frame = ts.spec(by, order).rowsBetween(-(window - 1), 0)
        both = pairs.select(*by, order, F.collect_list(F.struct(x, y)).over(frame).alias("_p")).where(F.size("_p") == window)
        # Ranks are made columns of their own first, so that each is computed once for a row.
        ranked = both.select(*by, order, ts.average_ranks_of(F.col(f"_p.{x}")).alias("_x"), ts.average_ranks_of(F.col(f"_p.{y}")).alias("_y"))
        return ranked.select(*by, order, ts.array_corr(F.col("_x"), F.col("_y")).alias("ic"))
    rows, keys = pairs.select(*by, order, x, y), list(by)
    if block_rows:
        block_rows = max(block_rows, window)
        rows = blocks.with_halo(blocks.in_blocks(blocks.positioned(rows, by, [order]), block_rows), window - 1, 0, block_rows)
        keys.append(blocks.BLOCK)
    kept = [*by, order]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        ic = sliding_spearman(frame[x].to_numpy(float), frame[y].to_numpy(float), window)
        out = frame[kept].iloc[window - 1 :].assign(ic=pd.Series(ic, dtype=object).where(~np.isnan(ic), None).to_numpy())
        return out[frame[blocks.OWN].iloc[window - 1 :].to_numpy(bool)] if block_rows else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.groupBy(*keys).applyInPandas(one, f"{schema}, ic double")


def ic_t_stat(df: DataFrame, ic: str = "ic", by=SIGNAL_KEYS) -> DataFrame:
    """mean / (std / sqrt n) of a series of coefficients; NULL under two of them or without spread."""
    made = df.groupBy(*by).agg(F.count(ic).alias("n"), F.avg(ic).alias("_m"), F.stddev_samp(ic).alias("_s"))
    t = F.when(F.col("n") >= 2, ts.ratio("_m", F.col("_s") / F.sqrt("n")))
    return made.select(*by, "n", F.col("_m").alias("mean_ic"), t.alias("t_stat"))


def block_ic(df: DataFrame, block_size: int = 60, x: str = "value", y: str = "fwd", by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """Spearman of each disjoint block of non-null pairs; a last incomplete block is left out: keys, block, n, ic."""
    pairs = df.where(ts.present(x, y))
    cut = pairs.select(*by, x, y, F.floor(ts.row_index(by, order) / block_size).cast("int").alias("block"))
    return ts.spearman(cut, x, y, [*by, "block"]).where(F.col("n") == block_size)


def non_overlapping_ic_t_stat(df: DataFrame, block_size: int = 60, x: str = "value", y: str = "fwd", by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    return ic_t_stat(block_ic(df, block_size, x, y, by, order), "ic", by)


def ic_decay(df: DataFrame, horizons=(1, 5, 10, 20), x: str = "value", price: str = "price", by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """Spearman of the signal with the price change over the next h rows, by horizon."""
    w = ts.spec(by, order)
    ahead = [F.struct(F.lit(h).alias("horizon"), (ts.ratio(F.lead(price, h).over(w), price) - 1.0).alias("fwd_h")) for h in horizons]
    long = df.select(*by, x, F.array(*ahead).alias("_a")).select(*by, x, F.explode("_a").alias("_h")).select(*by, x, "_h.horizon", "_h.fwd_h")
    return ts.spearman(long, x, "fwd_h", [*by, "horizon"])


def signal_autocorrelation(df: DataFrame, lag: int = 1, x: str = "value", by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """Correlation of the non-null values with those ``lag`` places earlier."""
    some = df.where(ts.present(x))
    pairs = some.select(*by, F.col(x).alias("_a"), F.lag(x, lag).over(ts.spec(by, order)).alias("_b")).where("_b is not null")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ts.correlation("_a", "_b").alias("autocorrelation"))


def implied_turnover(df: DataFrame, x: str = "value", by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """Share of non-null rows on which the sign changes; the first row counts as no change."""
    some = df.where(ts.present(x)).withColumn("_s", F.signum(x))
    changed = F.coalesce(F.abs(F.col("_s") - F.lag("_s").over(ts.spec(by, order))) > 0, F.lit(False))
    return some.select(*by, changed.cast("double").alias("_c")).groupBy(*by).agg(F.avg("_c").alias("turnover"))


def quantile_returns(df: DataFrame, bins: int = 5, x: str = "value", y: str = "fwd", by=SIGNAL_KEYS) -> DataFrame:
    """Mean forward return and count of each quantile bin of the signal."""
    pairs = df.where(ts.present(x, y))
    binned = ts.quantile_bins(pairs.select(*by, x, y), x, bins, by)
    return binned.groupBy(*by, F.concat(F.lit("bin_"), F.col("bin")).alias("bin")).agg(F.avg(y).alias("mean_return"), F.count(F.lit(1)).alias("n"))


def signal_sharpe(df: DataFrame, cost: float = 0.0002, x: str = "value", y: str = "fwd", by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """Annualised Sharpe ratio of the signal's sign after turnover cost; 0 without spread."""
    pairs = df.where(ts.present(x, y)).withColumn("_p", F.signum(x))
    net = F.col("_p") * F.col(y) - ts.diff_abs_or_self("_p", ts.spec(by, order)) * F.lit(cost)
    return pairs.select(*by, net.alias("_r")).groupBy(*by).agg(sharpe("_r").alias("sharpe"))


def sharpe(r: Column | str, ddof: int = 1, periods: int = PERIODS) -> Column:
    """Aggregate: annualised mean over standard deviation, 0 where that is 0."""
    std = F.stddev_samp(r) if ddof else F.stddev_pop(r)
    return F.when(std == 0, F.lit(0.0)).otherwise(F.sqrt(F.lit(float(periods))) * F.avg(r) / std)


def alpha_report(df: DataFrame, cost: float = 0.0002, horizons=(1, 5, 10, 20), window: int = 60, bins: int = 5, by=SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """One row for each key: ic, t statistics, decay map, autocorrelation, turnover, bins, Sharpe ratio.

    ``df`` has value, price and fwd. What the report reads of it is written once, as every part starts from it.
    """
    keys = list(by)
    df = store.written(df.select(*keys, order, "value", "price", "fwd"), "signals")
    naive = ic_t_stat(rolling_ic(df, window, by=by, order=order), by=by).select(*keys, F.col("t_stat").alias("naive_t_stat"))
    blocks = non_overlapping_ic_t_stat(df, window, by=by, order=order).select(*keys, F.col("t_stat").alias("block_t_stat"))
    decay = ic_decay(df, horizons, by=by, order=order).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", "ic")))).alias("decay"))
    quantiles = quantile_returns(df, bins, by=by).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "mean_return", "n"))).alias("bins"))
    out = information_coefficient(df, by=by).select(*keys, "n", "ic")
    for part in (naive, blocks, decay, signal_autocorrelation(df, by=by, order=order).select(*keys, "autocorrelation"), implied_turnover(df, by=by, order=order), quantiles, signal_sharpe(df, cost, by=by, order=order)):
        out = out.join(part, keys, "left")
    return out


# --- matrices of signals ----------------------------------------------------


def signal_correlation(wide: DataFrame, signals: list[str], by=ts.KEYS) -> DataFrame:
    """Pearson correlation of every pair of signal columns, over the pairs' non-null rows: keys, a, b, rho."""
    names = [(a, b) for a in signals for b in signals]
    made = wide.groupBy(*by).agg(*[ts.correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("rho")) for i, (a, b) in enumerate(names)])
    return made.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.a", "_c.b", "_c.rho")


def zscore_columns(wide: DataFrame, signals: list[str], by=ts.KEYS, suffix: str = "") -> DataFrame:
    """Each column less its mean over its sample deviation, within the keys."""
    facts = {f"_m_{c}": F.avg(c) for c in signals} | {f"_s_{c}": F.stddev_samp(c) for c in signals}
    made = {f"{c}{suffix}": ts.ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}") for c in signals}
    return ts.with_group_facts(wide, by, **facts).withColumns(made).drop(*facts)


def combine_equal_weight(wide: DataFrame, signals: list[str], by=ts.KEYS, out: str = "combined") -> DataFrame:
    """Mean of the z-scores that are not null; NULL if all are."""
    z = zscore_columns(wide, signals, by, "__z")
    names = [f"{c}__z" for c in signals]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return z.withColumn(out, ts.ratio(total, count)).drop(*names)


def ic_weights(wide: DataFrame, signals: list[str], fwd: str = "fwd", by=ts.KEYS) -> DataFrame:
    """keys, weights (map of signal to IC over the sum of absolute ICs; NULL ICs count as 0)."""
    long = wide.unpivot([*by, fwd], signals, "signal", "value")
    ics = information_coefficient(long, "value", fwd, [*by, "signal"])
    total = F.sum(F.abs("ic")).over(Window.partitionBy(*by))
    weighted = ics.select(*by, "signal", F.coalesce(ts.ratio("ic", total), F.lit(0.0)).alias("weight"))
    return weighted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("signal", "weight"))).alias("weights"))


def combine_ic_weighted(wide: DataFrame, signals: list[str], fwd: str = "fwd", by=ts.KEYS, out: str = "combined") -> DataFrame:
    """Sum of z-scores by IC weight; null scores count as 0."""
    z = zscore_columns(wide, signals, by, "__z").join(ic_weights(wide, signals, fwd, by), list(by))
    total = sum((F.coalesce(F.col(f"{c}__z") * F.coalesce(F.col("weights")[c], F.lit(0.0)), F.lit(0.0)) for c in signals), F.lit(0.0))
    return z.withColumn(out, total).drop(*[f"{c}__z" for c in signals], "weights")


def ridge_weights(complete: DataFrame, signals: list[str], fwd: str = "fwd", alpha: float = 1.0, by=ts.KEYS) -> DataFrame:
    """keys, weights (array in the order of ``signals``): ridge coefficients of each group, from one aggregate of centred cross products."""
    columns = [*signals, fwd]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = F.array(*[F.covar_pop(columns[i], columns[j]) * F.count(F.lit(1)) for i, j in pairs])
    k = len(signals)

    def solve(cells: pd.Series) -> pd.Series:
        out = []
        for row in cells:
            cross = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, row, strict=True):
                cross[i, j] = cross[j, i] = v
            out.append(np.linalg.solve(cross[:k, :k] + alpha * np.eye(k), cross[:k, k]))
        return pd.Series(out)

    made = complete.groupBy(*by).agg(sums.alias("_c"))
    return made.select(*by, F.pandas_udf(solve, "array<double>")("_c").alias("weights"))


def combine_ridge(wide: DataFrame, signals: list[str], fwd: str = "fwd", alpha: float = 1.0, by=ts.KEYS, out: str = "combined") -> DataFrame:
    """Ridge regression, within the keys, of the forward return on z-scored signals; the fitted intercept is left out of the result."""
    complete = zscore_columns(wide.dropna(subset=[*signals, fwd]), signals, by)
    weighted = complete.join(ridge_weights(complete, signals, fwd, alpha, by), list(by))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col("weights")[i] for i, c in enumerate(signals)), F.lit(0.0))
    return weighted.withColumn(out, total).drop("weights")


def orthogonalize(wide: DataFrame, signals: list[str], by=ts.KEYS) -> DataFrame:
    """Residuals of each signal on an intercept and the residuals before it; rows with a null signal go, the first signal stays.

    Residuals are orthogonal to each other, so each slope is a covariance over a
    variance. Both follow from the signals' own covariances, which are one
    aggregate of each group: no pass over the rows is made for a residual.
    """
    complete = wide.dropna(subset=signals)
    k = len(signals)
    facts = {f"_m{i}": F.avg(c) for i, c in enumerate(signals)}
    facts |= {f"_c{i}_{j}": F.covar_pop(signals[i], signals[j]) for i in range(k) for j in range(i + 1)}
    keys = [f"_key_{x}" for x in by]
    stats = complete.groupBy(*[F.col(x).alias(n) for x, n in zip(by, keys, strict=True)]).agg(*[c.alias(n) for n, c in facts.items()])
    for i in range(k):  # _v: variance of a residual; _b: slope of signal i on residual j
        for j in range(i):
            rest = F.col(f"_c{i}_{j}") - sum((F.col(f"_b{i}_{m}") * F.col(f"_b{j}_{m}") * F.col(f"_v{m}") for m in range(j)), F.lit(0.0))
            stats = stats.withColumn(f"_b{i}_{j}", F.coalesce(ts.ratio(rest, f"_v{j}"), F.lit(0.0)))
        own = F.col(f"_c{i}_{i}") - sum((F.col(f"_b{i}_{m}") * F.col(f"_b{i}_{m}") * F.col(f"_v{m}") for m in range(i)), F.lit(0.0))
        # What rounding leaves of the variance of a combination of the others is no variance.
        stats = stats.withColumn(f"_v{i}", F.when(own > F.lit(1e-13) * F.col(f"_c{i}_{i}"), own).otherwise(F.lit(0.0)))
    same = F.lit(True)
    for x, n in zip(by, keys, strict=True):
        same = same & complete[x].eqNullSafe(stats[n])
    out = complete.join(stats, same)
    for i, c in enumerate(signals):
        left = F.col(c) - F.col(f"_m{i}") - sum((F.col(f"_b{i}_{j}") * F.col(f"_r{j}") for j in range(i)), F.lit(0.0))
        out = out.withColumn(f"_r{i}", left)
    return out.select(*[F.col(f"_r{signals.index(c)}").alias(c) if c in signals[1:] else F.col(c) for c in wide.columns])
