"""Windows, running totals, ranks and percentiles of keys that are larger than one task.

A plain window gathers a key's rows in one task. Here rows are range-partitioned
by (key, order, tie), so that a key is spread over as many tasks as it has rows
for, and every row gets its exact position within its key from the counts of the
parts before its own. All else follows from positions:

- A block is ``block_rows`` consecutive positions of a key. A bounded window
  frame is evaluated in each block with halo rows: copies of the nearest rows of
  the neighbour blocks.
- A running total is that of the block so far, and the total of all blocks
  before it: one row for each block is all that meets by key.
- A rank is a position, or the mean of the first and last position of equal
  values; equal values that cross the border of blocks are completed from the
  borders' own small table. A percentile is read off at its position.

A hot value is no hot task, as ``tie`` orders equal values over many parts.
Parts and blocks of a key are the only things counted in one task: their number
is rows / block_rows.

Defined cases: null keys are a key of their own; an empty frame gives an empty
one; null values of an order come first; rows equal in key, order and tie are
ordered as they happen to arrive (name a tie that tells them apart where that
would matter).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.sources import store

#: Rows of a block: what one task holds of a key.
BLOCK_ROWS = 1 << 20
POS, BLOCK, OWN = "_pos", "_block", "_own"
_AT, _PART = "_at", "_part"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys``, whose columns are named ``_k_...`` on the right."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_k_{k}"])
    return out


def _keyed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_k_{k}") for k in keys]


def _attached(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``facts``, whose keys are named ``_k_...``."""
    return rows.join(facts, _same(rows, facts, keys), how).drop(*[f"_k_{k}" for k in keys])


def positioned(df: DataFrame, by: Sequence[str], order: Sequence[str], tie: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with ``_pos``, the row's 0-based position within its key. Rows are written once, range-partitioned and sorted."""
    spark = df.sparkSession
    sort = [*by, *order, *tie]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row's place in its sorted part is the low 33 bits of its id, the part the bits above.
    ranged = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn(_AT, F.monotonically_increasing_id())
    rows = store.written(ranged, "ranged").withColumn(_PART, F.shiftright(_AT, 33))
    counted = rows.groupBy(*_keyed([*by, _PART])).agg(F.min(_AT).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[f"_k_{k}" for k in by]).orderBy(f"_k_{_PART}").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return _attached(rows, starts, [*by, _PART]).withColumn(POS, F.col(_AT) + F.col("_start")).drop(_AT, _PART, "_start")


def in_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Positioned rows with ``_block``."""
    return rows.withColumn(BLOCK, F.floor(F.col(POS) / block_rows).cast("long"))


def block_spec(by: Sequence[str]) -> WindowSpec:
    """Each block of a key in order."""
    return Window.partitionBy(*by, BLOCK).orderBy(POS)


# --- bounded frames ---------------------------------------------------------


def with_halo(rows: DataFrame, before: int, after: int, block_rows: int) -> DataFrame:
    """Rows of ``in_blocks`` with ``_own``: true for each row, false for its copy in a neighbour block whose frames reach it. ``block_rows`` must be no less than either reach."""
    place, block = F.pmod(F.col(POS), F.lit(block_rows)), F.col(BLOCK)
    copies = [F.struct(block.alias(BLOCK), F.lit(True).alias(OWN))]
    if before:
        copies.append(F.when(place >= block_rows - before, F.struct((block + 1).alias(BLOCK), F.lit(False).alias(OWN))))
    if after:
        copies.append(F.when((place < after) & (block > 0), F.struct((block - 1).alias(BLOCK), F.lit(False).alias(OWN))))
    return rows.withColumn("_copy", F.explode(F.array_compact(F.array(*copies)))).drop(BLOCK).select("*", "_copy.*").drop("_copy")


def windowed(
    df: DataFrame, make: Callable[[DataFrame, list[str], str], DataFrame], before: int, after: int = 0, by: Sequence[str] = ts.KEYS, order: str = "date",
    tie: Sequence[str] = (), block_rows: int = BLOCK_ROWS, parts: int | None = None,
) -> DataFrame:
    """What ``make(frame, by, order)`` makes of each block with its halo, for the block's own rows; ``_pos`` and ``_block`` stay.

    ``make`` must add columns by windows of the given keys and order that look back
    over ``before`` and ahead over ``after`` rows at most, nested ones included; it
    may drop rows and must keep ``_own``.
    """
    block_rows = max(block_rows, before, after, 1)
    rows = in_blocks(positioned(df, by, [order], tie, parts), block_rows)
    return make(with_halo(rows, before, after, block_rows), [*by, BLOCK], POS).where(OWN).drop(OWN)


# --- running totals ---------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """An associative total: ``fold`` as an aggregate, ``join`` of what came before (null: nothing) and the block's own."""

    fold: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


def _or_other(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


SUM = Scan(F.sum, _or_other(lambda a, b: a + b))
PRODUCT = Scan(F.product, _or_other(lambda a, b: a * b))
MAX = Scan(F.max, lambda a, b: F.greatest(a, b))
MIN = Scan(F.min, lambda a, b: F.least(a, b))
LAST = Scan(lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def running(rows: DataFrame, totals: dict[str, tuple[Scan, Column | str]], by: Sequence[str] = ts.KEYS) -> DataFrame:
    """Rows of ``in_blocks`` with running totals from each key's first row on: name -> (scan, column).

    Two levels: each block's total, one row for each block; their running totals by
    key; and the running total within the block, joined to what came before it.
    """
    w = block_spec(by).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_own_{n}": scan.fold(ts.as_col(c)).over(w) for n, (scan, c) in totals.items()})
    ends = rows.groupBy(*_keyed([*by, BLOCK])).agg(*[_ordered(scan, ts.as_col(c)).alias(f"_end_{n}") for n, (scan, c) in totals.items()])
    past = Window.partitionBy(*[f"_k_{k}" for k in by]).orderBy(f"_k_{BLOCK}").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[f"_k_{k}" for k in [*by, BLOCK]], *[scan.fold(F.col(f"_end_{n}")).over(past).alias(f"_past_{n}") for n, (scan, _) in totals.items()])
    made = _attached(own, carried, [*by, BLOCK])
    out = made.withColumns({n: scan.join(F.col(f"_past_{n}"), F.col(f"_own_{n}")) for n, (scan, _) in totals.items()})
    return out.drop(*[f"{p}{n}" for n in totals for p in ("_own_", "_past_")])


def _ordered(scan: Scan, c: Column) -> Column:
    """The scan as an aggregate of rows in any order."""
    return F.max_by(c, F.when(c.isNotNull(), F.col(POS))) if scan is LAST else scan.fold(c)


# --- ranks and percentiles --------------------------------------------------


def average_ranks(df: DataFrame, c: str, by: Sequence[str], tie: Sequence[str], out: str = "rank", block_rows: int = BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """``df`` with the rank of ``c`` from 1 within the key, equal values sharing the mean of their ranks.

    ``tie``: columns that tell equal values' rows apart, so that they spread.
    """
    rows = in_blocks(positioned(df, by, [c], tie, parts), block_rows)
    near = Window.partitionBy(*by, BLOCK, c)
    # A run of equal values at its block's first or last position may go on in the neighbour: two values a block at most.
    place = F.pmod(F.col(POS), F.lit(block_rows))
    borders = rows.where((place == 0) | (place == block_rows - 1)).select(*_keyed([*by, c])).distinct()
    edges = _attached(rows.select(*by, c, POS), borders, [*by, c]).groupBy(*_keyed([*by, c])).agg(F.min(POS).alias("_from"), F.max(POS).alias("_to"))
    made = _attached(rows.withColumns({"_low": F.min(POS).over(near), "_high": F.max(POS).over(near)}), edges, [*by, c], "left")
    low, high = F.coalesce("_from", "_low"), F.coalesce("_to", "_high")
    return made.withColumn(out, (low + high) / 2.0 + 1.0).drop("_low", "_high", "_from", "_to", POS, BLOCK)


def percentiles(df: DataFrame, c: str, points: Sequence[float], by: Sequence[str], tie: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """keys, q: the exact percentiles of the non-null values at ``points`` (0 to 1), between neighbours in proportion."""
    rows = positioned(df.where(F.col(c).isNotNull()).select(*by, *[t for t in tie if t not in (*by, c)], c), by, [c], tie, parts)
    sizes = rows.groupBy(*_keyed(by)).agg(F.count(F.lit(1)).alias("_n"))
    at = [(F.col("_n") - 1) * float(p) for p in points]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    # Two positions for each point and key: the rows there are all that is gathered.
    places = sizes.select("*", F.explode(wanted).alias(f"_k_{POS}"))
    found = _attached(rows, places, [*by, POS]).groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct(POS, F.col(c).cast("double").alias("v")))).alias("_v"))
    low, high = [F.col("_v")[F.floor(x)] for x in at], [F.col("_v")[F.ceil(x)] for x in at]
    return found.select(*by, F.array(*[a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, at, strict=True)]).alias("q"))
