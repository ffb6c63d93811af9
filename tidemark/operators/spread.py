"""Evaluation and backtests of keys larger than a task, by the blocks of ``blocks.py``.

Each function gives the rows of its plain namesake in ``evaluate``, ``backtest``,
``models``, ``portfolio`` or ``ts``; a key's rows are dealt to as many tasks as it
has blocks. Small keys are better served by the plain forms, which need one
exchange and no table between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import backtest as bt
from tidemark.operators import blocks
from tidemark.operators.evaluate import SIGNAL_KEYS
from tidemark.sources import store


def run_backtest(
    predictions: DataFrame, entry_threshold: Column | float = 0.54, transaction_cost: float = 0.0002, by: Sequence[str] = ts.KEYS, order: str = "date",
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """The ledger of ``backtest.run_backtest``: turnover from a halo of one row, equity a running product, its peak a running maximum."""
    placed = predictions.withColumn("position", bt.direction("probability", entry_threshold).cast("int"))

    def make(frame: DataFrame, keys: list[str], place: str) -> DataFrame:
        return frame.withColumn("turnover", ts.diff_abs_or_self("position", ts.spec(keys, place)))

    rows = blocks.windowed(placed, make, 1, by=by, order=order, block_rows=block_rows)
    rows = rows.withColumn("strategy_return", F.col("position") * F.col("next_return") - F.col("turnover") * F.lit(float(transaction_cost)))
    # Written, as both levels of each total read it.
    rows = store.written(blocks.running(store.written(rows, "returns"), {"equity": (blocks.PRODUCT, 1.0 + F.col("strategy_return"))}, by), "equity")
    peaks = blocks.running(rows, {"_peak": (blocks.MAX, "equity")}, by)
    return peaks.withColumn("drawdown", ts.ratio("equity", "_peak") - 1.0).drop("_peak", blocks.POS, blocks.BLOCK)


def runs(df: DataFrame, c: str, by: Sequence[str] = ts.KEYS, order: str = "date", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Maximal runs of equal values, as ``ts.runs``: by, run, value, first, last, length. A run is numbered by the running number of changes."""

    def make(frame: DataFrame, keys: list[str], place: str) -> DataFrame:
        changed = ~F.col(c).eqNullSafe(F.lag(c).over(ts.spec(keys, place)))
        return frame.withColumn("_new", F.when(F.col(place) == 0, 1).otherwise(changed.cast("int")))

    rows = store.written(blocks.windowed(df.select(*by, order, c), make, 1, by=by, order=order, block_rows=block_rows), "changes")
    marked = blocks.running(rows, {"run": (blocks.SUM, "_new")}, by)
    value = F.min_by(c, blocks.POS).alias("value")
    return marked.groupBy(*by, F.col("run").cast("int").alias("run")).agg(value, F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))


def information_coefficient(
    df: DataFrame, x: str = "value", y: str = "fwd", by: Sequence[str] = SIGNAL_KEYS, order: str = "date", min_pairs: int = 10, block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Spearman correlation by key: n, ic. Rows are ranked by one side, then by the other; ``order`` spreads equal values."""
    pairs = df.where(ts.present(x, y)).select(*by, order, x, y)
    ranked = blocks.average_ranks(pairs, x, by, [order], "_rx", block_rows)
    ranked = blocks.average_ranks(ranked.select(*by, order, y, "_rx"), y, by, [order], "_ry", block_rows)
    made = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ts.correlation("_rx", "_ry").alias("ic"))
    return made.select(*by, "n", F.when(F.col("n") >= min_pairs, F.col("ic")).alias("ic"))


def quantile_returns(df: DataFrame, bins: int = 5, x: str = "value", y: str = "fwd", by: Sequence[str] = SIGNAL_KEYS, order: str = "date") -> DataFrame:
    """Mean forward return and count of each quantile bin, its edges read off at their positions."""
    pairs = df.where(ts.present(x, y)).select(*by, order, x, y)
    edges = blocks.percentiles(pairs, x, [k / bins for k in range(bins + 1)], by, [order])
    edges = edges.withColumn("_edges", ts.inner_edges(F.array_distinct("q"))).drop("q")
    binned = pairs.join(edges, list(by)).withColumn("bin", F.concat(F.lit("bin_"), ts.bin_of(x, F.col("_edges"))))
    return binned.groupBy(*by, "bin").agg(F.avg(y).alias("mean_return"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, score: str, target: str, by: Sequence[str], tie: Sequence[str], block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """keys, n, positives, auc: from the ranks of the positive rows; NULL where a class is missing."""
    some = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*by, *tie, score, target)
    ranked = blocks.average_ranks(some, score, by, tie, "_r", block_rows)
    positive = F.col(target) == 1
    total = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("positives"), F.sum(F.when(positive, F.col("_r"))).alias("_r"))
    p, q = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return total.select(*by, "n", "positives", ts.ratio(F.col("_r") - p * (p + 1) / 2.0, p * q).alias("auc"))


def quantile_long_short(df: DataFrame, signal: str, by: Sequence[str], tie: str, quantiles: int = 5, out: str = "weight") -> DataFrame:
    """Weights of +0.5 over the top and -0.5 over the bottom bucket of each cross-section; a row's rank is its position, bucket sizes are counts."""
    rows = blocks.positioned(df.where(F.col(signal).isNotNull()), by, [signal], [tie])
    rows = ts.with_group_facts(rows, by, _n=F.count(F.lit(1)))
    edges = F.array(*[1.0 + (F.col("_n") - 1) * (k / quantiles) for k in range(1, quantiles)])
    rows = rows.withColumn("_bucket", F.size(F.filter(edges, lambda e: e < F.col(blocks.POS) + 1)))
    rows = ts.with_group_facts(rows, by, _top=F.count_if(F.col("_bucket") == quantiles - 1), _bottom=F.count_if(F.col("_bucket") == 0))
    weight = F.when(F.col("_bucket") == quantiles - 1, 0.5 / F.col("_top")).when(F.col("_bucket") == 0, -0.5 / F.col("_bottom")).otherwise(F.lit(0.0))
    return rows.withColumn(out, weight).drop("_n", "_bucket", "_top", "_bottom", blocks.POS)
