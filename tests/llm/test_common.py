"""Shared helpers: salted group statistics, filters, splits and folders."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def test_group_stats_equal_plain_groups(spark):
    rows = spark.createDataFrame([(k % 3 if k < 60 else 9, k) for k in range(300)], "key int, v int")
    got = common.with_group_stats(rows, ["key"], {"n": ("count", F.lit(1)), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "total": ("sum", F.col("v"))}, F.pmod(F.xxhash64("v"), F.lit(8)))
    plain = {r.key: r for r in rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total")).collect()}
    found = got.collect()
    assert len(found) == 300 and all((r.n, r.low, r.high, r.total) == tuple(plain[r.key])[1:] for r in found)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_filter_has_no_false_negatives(spark, bits):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    bitmaps = common.bloom_of(keys, "key", bits, "test")
    one, two = common.cells(F.col("key"), bits)
    probed = lambda df: common.probe(df.withColumns({"c1": one, "c2": two}), ["c1", "c2"], bitmaps, "maybe")
    assert probed(keys).where("not maybe").count() == 0
    others = spark.range(10_000, 14_000).select(F.xxhash64("id").alias("key"))
    share = probed(others).where("maybe").count() / 4000
    assert share < (0.02 if bits > 1 << 15 else 0.1) and probed(others).count() == 4000


def test_sizes():
    assert common.filter_bits(0) == 1 << 15 and common.filter_bits(10**12) == common.MAX_FILTER_BITS
    assert common.salts_for(10) == 64 and common.salts_for(10**9) >= 1000 and common.salts_for(10**15) == 1 << 16


def test_held_out_matches_crc32(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(50), 2**40, -7, None]], "doc_id long").withColumn("h", common.held_out(F.col("doc_id"))).collect()
    assert all(r.h == common.is_held_out(r.doc_id) for r in rows)
    assert common.is_held_out(5) == (zlib.crc32(b"5") % 4 == 2)


def test_written_tables_stand_in_the_shared_folder(spark):
    df = common.written(spark.range(5), "kept")
    assert df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(common.shared_dir(spark).removeprefix("file:").replace("//", "/"))
