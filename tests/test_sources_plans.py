"""Readers, cache, calendar, streaming, and every oracle on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.operators import regimes, simulate
from tidemark.plans import catalogue
from tidemark.sources import market
from tidemark.streaming import online

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def prices(spark, n=30):
    return spark.createDataFrame([(d.date(), 100.0 + k) for k, d in enumerate(pd.bdate_range("2020-01-01", periods=n))], "date date, price double")


def test_cache(spark, tmp_path):
    calls = []

    def download(name):
        calls.append(name)
        return prices(spark, 30 + len(calls))

    for fmt in ("csv", "parquet"):
        where = str(tmp_path / fmt)
        calls.clear()
        assert market.load_series(spark, "X", where, download, fmt=fmt).count() == 30
        again = market.load_series(spark, "X", where, download, fmt=fmt)
        assert again.count() == 30 and calls == ["X"] and again.columns == ["series_id", "date", "price", "return"]
        assert market.load_series(spark, "X", where, download, refresh=True, fmt=fmt).count() == 31
    with pytest.raises(market.EmptySource):
        market.load_series(spark, "Y", str(tmp_path / "csv"), lambda _: prices(spark).limit(0))
    with pytest.raises(FileNotFoundError):
        market.load_series(spark, "Z", str(tmp_path / "csv"))
    panel = market.load_panel(spark, {"a": str(tmp_path / "csv/X.csv"), "b": str(tmp_path / "csv/X.csv")}, "csv")
    assert {r.series_id: r["count"] for r in panel.groupBy("series_id").count().collect()} == {"a": 31, "b": 31}


@pytest.mark.parametrize("start", ["2016-01-01", "2016-01-02", "2016-01-03", "2016-01-04", "2016-01-06"])
def test_calendar(spark, start):
    got = market.business_days(spark, start, 100).orderBy("t").toPandas()
    assert list(got["t"]) == list(range(100)) and list(pd.to_datetime(got["date"])) == list(pd.bdate_range(start, periods=100))


def test_scans_are_pruned(spark, sf_dir):
    plan = market.daily_series(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan and "l_comment" not in plan and "l_orderkey" not in plan


def test_streamed_filter_equals_batch(spark, tmp_path):
    frame = simulate.simulate_market(spark, 90, seed=2, n_series=2).select("series_id", "date", "return")
    parts = frame.toPandas().sort_values("date").reset_index(drop=True)
    for k in range(3):
        spark.createDataFrame(parts[k * 60 : (k + 1) * 60], frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = regimes.hamilton_filter(frame, simulate.TRANSITION, simulate.DRIFT, simulate.VOLATILITY).toPandas()
    files = sorted((os.path.getmtime(tmp_path / "in" / f), f) for f in os.listdir(tmp_path / "in") if f.endswith(".parquet"))
    for k, (_, f) in enumerate(files):
        os.utime(tmp_path / "in" / f, (1_000_000 + k * 10,) * 2)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = online.filter_stream(stream, simulate.TRANSITION, simulate.DRIFT, simulate.VOLATILITY)
    run = out.writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("filtered").toPandas()
    both = got.merge(batch, on=["series_id", "date"], suffixes=("_s", "_b"))
    assert len(both) == 180 and np.allclose(np.stack(both["probabilities_s"].to_list()), np.stack(both["probabilities_b"].to_list()))


def test_windowed_means_stream(spark, sf_dir, tmp_path):
    events = market.table(spark, sf_dir, "events")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    run = online.windowed_means(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("windows").count() == online.windowed_means(events).count()


def _same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)

    def norm(x):
        x = x[sorted(x.columns)].copy()
        for c in x.columns:
            if x[c].dtype.kind in "fib":
                x[c] = x[c].astype(float)
            elif x[c].dtype.kind == "M" or c in ("date", "first", "last", "start", "year"):
                x[c] = pd.to_datetime(x[c]).astype(str)
            else:
                x[c] = x[c].astype(str)
        text = [c for c in x.columns if x[c].dtype.kind != "f"]
        return x.sort_values(text + [c for c in x.columns if c not in text]).reset_index(drop=True)

    pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False, rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracles(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    _same(catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 1 and "annualised_sharpe" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
