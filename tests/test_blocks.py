"""Block windows, scans, ranks and percentiles against plain windows and aggregates."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks


@pytest.fixture(scope="module")
def rows(spark):
    """One key of most rows, a small one and a null one; a third of the values are equal."""
    key = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 40 == 1, "small").otherwise("large")
    value = F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 101 == 7, None).otherwise((F.col("id") * 7919 % 97).cast("double"))
    return spark.range(4000).select(key.alias("k"), "id", value.alias("v")).cache()


def test_positions_are_row_numbers(rows):
    plain = F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1
    both = blocks.positioned(rows, ["k"], ["id"], parts=7).withColumn("plain", plain)
    assert both.where(F.col("_pos") != F.col("plain")).count() == 0
    assert both.count() == 4000


@pytest.mark.parametrize("block_rows", [64, 1000, 10_000])
def test_frames_equal_plain_windows(rows, block_rows):
    def make(frame, by, order):
        w = ts.spec(by, order)
        return frame.withColumns({"mean": ts.rolling(F.avg, "v", 30, 5, w, shift=2), "next": F.lead("id", 3).over(w)})

    got = blocks.windowed(rows, make, 31, 3, ["k"], "id", block_rows=block_rows)
    want = make(rows, ["k"], "id").select("id", F.col("mean").alias("mean2"), F.col("next").alias("next2"))
    both = got.join(want, "id")
    assert both.count() == 4000
    assert both.where(~(F.col("next").eqNullSafe(F.col("next2"))) | ~(F.round("mean", 9).eqNullSafe(F.round("mean2", 9)))).count() == 0


def test_scans_equal_plain_running_totals(rows):
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("id") % 700 == 5, F.col("id"))
    totals = {"s": (blocks.SUM, "v"), "high": (blocks.MAX, "v"), "low": (blocks.MIN, "v"), "mark": (blocks.LAST, mark), "p": (blocks.PRODUCT, 1 + F.col("v") / 1e6)}
    plain = {"s": F.sum("v"), "high": F.max("v"), "low": F.min("v"), "mark": F.last(mark, ignorenulls=True), "p": F.product(1 + F.col("v") / 1e6)}
    got = blocks.running(blocks.in_blocks(blocks.positioned(rows, ["k"], ["id"]), 128), totals, ["k"])
    both = got.join(rows.select("id", *[c.over(w).alias(f"{n}2") for n, c in plain.items()]), "id")
    differs = [~F.round(n, 9).eqNullSafe(F.round(f"{n}2", 9)) for n in plain]
    assert both.count() == 4000
    assert [both.where(d).count() for d in differs] == [0] * len(differs)


@pytest.mark.parametrize("block_rows", [1, 50, 5000])
def test_average_ranks_equal_plain_ranks(rows, block_rows):
    some = rows.where("v is not null and k is not null").where("id < 900" if block_rows == 1 else "true")
    got = blocks.average_ranks(some, "v", ["k"], ["id"], block_rows=block_rows)
    both = got.join(some.select("id", ts.average_rank("v", ["k"]).alias("plain")), "id")
    assert both.count() == some.count()
    assert both.where(F.col("rank") != F.col("plain")).count() == 0


def test_percentiles_equal_the_aggregate(rows):
    points = [0.0, 0.2, 1 / 3, 0.5, 0.999, 1.0]
    plain = {r["k"]: r["q"] for r in rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("q")).collect()}
    got = {r["k"]: r["q"] for r in blocks.percentiles(rows, "v", points, ["k"], ["id"]).collect()}
    assert got.keys() == plain.keys()
    for k in plain:
        assert got[k] == pytest.approx(plain[k], abs=1e-12)


def test_no_task_takes_a_key(rows, spark):
    """The key of nine tenths of the rows lies in all parts, and no exchange of rows goes to a single partition."""
    placed = blocks.positioned(rows.where("k = 'large'"), ["k"], ["v"], ["id"], parts=8)
    cut = blocks.in_blocks(placed, 100)
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert max(sizes) == 100 and len(sizes) >= 30
    plan = blocks.average_ranks(rows, "v", ["k"], ["id"], block_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_empty_frame(spark):
    none = spark.createDataFrame([], "k string, id long, v double")
    assert blocks.average_ranks(none, "v", ["k"], ["id"]).count() == 0
    assert blocks.percentiles(none, "v", [0.5], ["k"]).count() == 0
    assert blocks.windowed(none, lambda f, by, o: f.withColumn("x", F.lag("v").over(ts.spec(by, o))), 1, 0, ["k"], "id").count() == 0
