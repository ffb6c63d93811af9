"""Time-series column builders over partitioned, ordered windows.

Missing values are NULL throughout, never NaN. A rolling value needs
``min_periods`` non-null inputs, else it is NULL; a shift is folded into the
window frame, so that all rolling columns of one partitioning share a sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("series_id",)


def spec(by: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    """Window over each group in order. Groups keep the work partitioned."""
    return Window.partitionBy(*by).orderBy(order)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_zero(c: Column | str) -> Column:
    return F.nullif(as_col(c).cast("double"), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return as_col(a).cast("double") / null_if_zero(b)


def no_nan(c: Column) -> Column:
    """NULL in place of NaN (some aggregates give NaN for constant inputs)."""
    return F.when(~F.isnan(c), c)


def present(*columns: str) -> Column:
    """Whether no column is NULL or NaN; frames made from pandas hold NaN for missing values."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def correlation(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson correlation over rows with both values; NULL, and no division error, for a constant side."""
    a, b = as_col(a), as_col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def rolling(fn: Callable[[Column], Column], c: Column | str, window: int, min_periods: int, w: WindowSpec, shift: int = 0) -> Column:
    """``fn`` over the last ``window`` rows, ending ``shift`` rows before the current one."""
    frame = w.rowsBetween(-(window - 1) - shift, -shift)
    c = as_col(c)
    return F.when(F.count(c).over(frame) >= min_periods, fn(c).over(frame))


def pct_change(c: Column | str, k: int, w: WindowSpec) -> Column:
    """c / (c k rows ago) - 1."""
    return ratio(c, F.lag(as_col(c), k).over(w)) - 1.0


def diff_abs_or_self(c: Column | str, w: WindowSpec) -> Column:
    """|c - previous c|; |c| on the first row, where a position is entered."""
    c = as_col(c)
    return F.coalesce(F.abs(c - F.lag(c).over(w)), F.abs(c))


def cumulative(fn: Callable[[Column], Column], c: Column | str, w: WindowSpec) -> Column:
    return fn(as_col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def zscore_trailing(c: Column | str, window: int, min_periods: int, w: WindowSpec, shift: int = 1) -> Column:
    """Z-score of the value ``shift`` rows ago in the window that ends with it; NULL while the window is constant."""
    value = F.lag(as_col(c), shift).over(w) if shift else as_col(c)
    mean = rolling(F.avg, c, window, min_periods, w, shift)
    return ratio(value - mean, rolling(F.stddev_samp, c, window, min_periods, w, shift))


def average_rank(c: Column | str, by: Sequence[str]) -> Column:
    """Rank from 1 within the group, ties sharing the mean of their ranks."""
    name = as_col(c)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, name))
    return F.rank().over(Window.partitionBy(*by).orderBy(name)) + (ties - 1) / 2.0


def uniform(part: int, seed: int, *key: str) -> Column:
    """A uniform draw in (0, 1) from 52 bits of the MD5 of the seed and the key's columns; ``part`` 0 and 1 are independent.

    It depends on the row's key alone, not on partitions, and any SQL engine can draw the same.
    """
    bits = F.conv(F.substring(_digest(seed, key), 1 + 13 * part, 13), 16, 10).cast("long").cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _digest(seed: int, key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def uniform_below(share: float, seed: int, *key: str) -> Column:
    """``uniform(0, seed, *key) < share``, told from the hexadecimal digits without making a number of them."""
    bound = math.ceil(Fraction(share) * (1 << 52) - Fraction(1, 2))
    return F.substring(_digest(seed, key), 1, 13) < F.lit(f"{bound:013x}") if bound < 1 << 52 else F.lit(True)


def row_index(by: Sequence[str] = KEYS, order: str = "date") -> Column:
    """0-based position within the group."""
    return (F.row_number().over(spec(by, order)) - 1).cast("int")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], min_pairs: int = 10) -> DataFrame:
    """``by`` columns, ``n`` and ``ic``: Spearman correlation of non-null pairs; NULL under ``min_pairs`` pairs or for a constant side."""
    pairs = df.where(present(x, y)).select(*by, x, y)
    ranked = pairs.select(*by, average_rank(x, by).alias("_rx"), average_rank(y, by).alias("_ry"))
    made = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("ic"))
    return made.select(*by, "n", F.when(F.col("n") >= min_pairs, F.col("ic")).alias("ic"))


def with_group_facts(df: DataFrame, by: Sequence[str], **facts: Column) -> DataFrame:
    """``df`` with aggregates of each row's group, made map-side and joined back, so that a group's rows never meet in one task for a mean.

    Null keys are a group of their own.
    """
    made = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in by]).agg(*[c.alias(name) for name, c in facts.items()])
    same = F.lit(True)
    for k in by:
        same = same & df[k].eqNullSafe(made[f"_key_{k}"])
    return df.join(made, same).drop(*[f"_key_{k}" for k in by])


def quantile_edges(c: Column | str, bins: int) -> Column:
    """Inner edges of equal-count bins: exact percentiles at all bins + 1 points, made distinct, without the outer two."""
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return inner_edges(F.array_distinct(F.percentile(as_col(c).cast("double"), points)))


def inner_edges(edges: Column) -> Column:
    """Without the outer two."""
    return F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))


def bin_of(c: Column | str, edges: Column) -> Column:
    """0-based bin of a value: how many inner edges lie below it."""
    return F.size(F.filter(edges, lambda e: e < as_col(c).cast("double")))


def quantile_bins(df: DataFrame, c: str, bins: int, by: Sequence[str], out: str = "bin") -> DataFrame:
    """``df`` without rows where c is NULL, with its quantile bin within each group."""
    some = df.where(F.col(c).isNotNull())
    edges = some.groupBy(*by).agg(quantile_edges(c, bins).alias("_edges"))
    return some.join(edges, list(by)).withColumn(out, bin_of(c, F.col("_edges"))).drop("_edges")


def runs(df: DataFrame, c: str, by: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    """Maximal runs of equal values (gaps and islands): by, run, value, first, last, length."""
    w = spec(by, order)
    changed = F.coalesce((~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_new", F.when(first, 1).otherwise(changed))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(*by, "run").agg(F.first(c).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))


def average_ranks_of(values: Column) -> Column:
    """Average ranks of the elements of an array."""
    return F.transform(
        values,
        lambda x: F.size(F.filter(values, lambda y: y < x)).cast("double") + (F.size(F.filter(values, lambda y: y == x)) + 1) / 2.0,
    )


def array_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays of equal length; NULL for a constant one."""
    n = F.size(x).cast("double")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    mx, my = total(x) / n, total(y) / n
    dx, dy = F.transform(x, lambda v: v - mx), F.transform(y, lambda v: v - my)
    cov = total(F.zip_with(dx, dy, lambda a, b: a * b))
    return ratio(cov, F.sqrt(total(F.transform(dx, lambda v: v * v)) * total(F.transform(dy, lambda v: v * v))))
