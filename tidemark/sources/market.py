"""Series and panels: readers, the file cache, calendars, and views over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ts
from tidemark.sources import store, versions

PRICES = T.StructType([T.StructField("date", T.DateType()), T.StructField("price", T.DoubleType())])
PANEL = T.StructType([*PRICES.fields, T.StructField("series_id", T.StringType())])


class EmptySource(ValueError):
    """A series source that gave no row."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_returns(prices: DataFrame, by=ts.KEYS, order: str = "date") -> DataFrame:
    """Adds ``return``, the relative change of ``price``; the first row of each series goes."""
    made = prices.withColumn("return", ts.pct_change("price", 1, ts.spec(by, order)))
    return made.where(F.col("return").isNotNull())


def read_series(spark: SparkSession, path: str, series_id: str, fmt: str = "parquet") -> DataFrame:
    """series_id, date, price, return from a file of (date, price), or its current version; the CSV reader takes a header and a fixed schema."""
    path = versions.current(spark, path) or path
    raw = spark.read.csv(path, header=True, schema=PRICES) if fmt == "csv" else spark.read.format(fmt).load(path)
    rows = raw.select(F.lit(series_id).alias("series_id"), F.to_date("date").alias("date"), F.col("price").cast("double").alias("price"))
    return with_returns(rows.where("date is not null"))


def load_series(
    spark: SparkSession, series_id: str, cache_dir: str, download: Callable[[str], DataFrame] | None = None, refresh: bool = False, fmt: str = "csv",
) -> DataFrame:
    """A series by its cached file; on a miss or ``refresh`` it is downloaded by the given function and written there first.

    The cache has one entry for each series, whatever range was asked for. A
    refresh publishes a new version of it: frames that read the old one keep it.
    """
    path = f"{cache_dir}/{series_id}.{fmt}"
    if refresh or not versions.published(spark, path):
        if download is None:
            raise FileNotFoundError(f"{path} is not cached and no download function is given")
        found = download(series_id).select(F.to_date("date").alias("date"), F.col("price").cast("double").alias("price"))
        if found.isEmpty():
            raise EmptySource(f"no data for {series_id}")
        versions.publish(found, path, fmt)
    return read_series(spark, path, series_id, fmt)


def write_series(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cache sink."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def load_panel(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """One long frame of some series' files; for many, ``publish_panel`` and ``read_panel`` make one scan of all."""
    if not paths:
        raise EmptySource("a panel needs a series")
    frames = [read_series(spark, path, name, fmt) for name, path in paths.items()]
    out = frames[0]
    for one in frames[1:]:
        out = out.unionByName(one)
    return out


def publish_panel(prices: DataFrame, root: str) -> None:
    """Publishes (series_id, date, price) as the current version of a panel: a folder for each series, a long series split by date."""
    some = prices.select(F.col("series_id").cast("string").alias("series_id"), F.to_date("date").alias("date"), F.col("price").cast("double").alias("price"))
    versions.publish(some.where("series_id is not null and date is not null"), root, partition_by=["series_id"], order=["date"])


def read_panel(spark: SparkSession, root: str) -> DataFrame:
    """series_id, date, price, return of a panel's current version: one scan, whatever the number of series; a filter on series_id reads their folders only."""
    path = versions.current(spark, root)
    if path is None:
        raise EmptySource(f"no panel is published under {root}")
    return with_returns(spark.read.schema(PANEL).parquet(path))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder, deleted when the driver's Python ends."""
    return store.new_path(spark, "market")


def business_days(spark: SparkSession, start: str, n: int) -> DataFrame:
    """(t, date): the first n weekdays from a date on; holidays are not modelled."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), n * 7 // 5 + 7))).alias("date"))
    # Position among weekdays in closed form, so that no global sort is needed.
    first = F.to_date(F.lit(start))
    gone = F.datediff("date", first)
    lead = F.weekday(first)
    t = F.floor((gone + lead) / 7) * 5 + F.weekday("date") - F.least(lead, F.lit(5))
    return days.where(F.weekday("date") < 5).select(t.cast("int").alias("t"), "date").where(F.col("t").between(0, n - 1))


# --- views over the test tables ---------------------------------------------


def _price(extended: str, quantity: str):
    """Volume-weighted price. Sums are exact decimals, so they do not depend on the order of addition."""
    exact = "decimal(18,2)"
    return ts.ratio(F.sum(F.col(extended).cast(exact)).cast("double"), F.sum(F.col(quantity).cast(exact)).cast("double"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id ('ALL'), date, price: volume-weighted price by ship date."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    # The key is made by the aggregate: one that the optimizer knows to be a constant would leave joins on it without a key.
    prices = lines.groupBy("date").agg(_price("l_extendedprice", "l_quantity").alias("price"), F.max(F.lit("ALL")).alias("series_id")).where("date is not null")
    return prices.select("series_id", "date", "price")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_returns(daily_prices(spark, sf_dir))


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (brand), date (first of month), price."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc(F.to_date("l_shipdate"), "month").alias("date"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("series_id"))
    return lines.join(parts, "l_partkey").groupBy("series_id", "date").agg(_price("l_extendedprice", "l_quantity").alias("price"))


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, price, return of the months in which every brand has a price."""
    # One row for each brand and month: written, so that the lines are read once for the three uses of it.
    prices = store.written(brand_prices(spark, sf_dir), "brand-prices")
    brands = prices.agg(F.countDistinct("series_id")).scalar()
    full = prices.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == brands).select("date")
    return with_returns(prices.join(full, "date", "left_semi"))


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id ('EVENTS'), date (hour), value: mean event value by hour."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("date"), F.col("value").cast("decimal(28,12)").alias("value"))
    means = events.groupBy("date").agg((F.sum("value").cast("double") / F.count("value")).alias("value"), F.max(F.lit("EVENTS")).alias("series_id"))
    return means.select("series_id", "date", "value")


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score, target: document length against its quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("target")).join(docs, "doc_id")
