"""Expanding walk-forward folds by position, without a join: each row names the folds that it takes part in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts


def fold_count(n: int, min_train: int, test: int) -> int:
    """Starts min_train, min_train + test, ... below n - test; the end is exclusive, so a last full window that ends at n is left out."""
    return len(range(min_train, n - test, test))


def fold_table(df: DataFrame, min_train: int, test: int, embargo: int = 0, by=ts.KEYS) -> DataFrame:
    """keys, n, fold, start, train_rows, test_rows."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"))
    starts = F.when(F.col("n") - test > min_train, F.sequence(F.lit(min_train), F.col("n") - test - 1, F.lit(test)))
    folds = n.select(*by, "n", F.posexplode(starts).alias("fold", "start"))
    return folds.select(*by, "n", "fold", "start", F.greatest(F.col("start") - embargo, F.lit(0)).alias("train_rows"), F.lit(test).alias("test_rows"))


def expanding_rows(df: DataFrame, min_train: int, test: int, embargo: int = 0, by=ts.KEYS, order: str = "date") -> DataFrame:
    """``df`` once for each fold that uses the row, with row, fold and is_test. Training rows end ``embargo`` rows before the fold's start.

    For fits, which need a fold's rows together: a series of n rows gives about
    n * n / (2 * test) rows, and a fold of one series is one group of at most n
    rows. Counts and sums of folds come from ``fold_counts`` instead.
    """
    all_rows = Window.partitionBy(*by)
    placed = df.withColumns({"row": ts.row_index(by, order), "_n": F.count(F.lit(1)).over(all_rows).cast("int")})
    folds = F.when(F.col("_n") - test > min_train, F.floor((F.col("_n") - test - 1 - min_train) / test).cast("int") + 1).otherwise(0)
    # The row tests in fold (row - min_train) div test, and trains in all folds that start after row + embargo.
    own = F.floor((F.col("row") - min_train) / test).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("row") + embargo - min_train) / test).cast("int") + 1)
    trains = F.when(first < folds, F.transform(F.sequence(first, folds - 1), lambda k: F.struct(k.alias("fold"), F.lit(False).alias("is_test")))).otherwise(F.array().cast("array<struct<fold:int,is_test:boolean>>"))
    tests = F.when((own >= 0) & (own < folds), F.array(F.struct(own.alias("fold"), F.lit(True).alias("is_test")))).otherwise(F.array().cast("array<struct<fold:int,is_test:boolean>>"))
    return placed.withColumn("_f", F.explode(F.concat(trains, tests))).select(*df.columns, "row", "_f.fold", "_f.is_test")


def fold_counts(df: DataFrame, min_train: int, test: int, embargoes=(0,), target: str = "target", by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, embargo, fold, train_rows, test_rows, train_positives, from running sums: no row is copied into its folds.

    A fold's training rows are the first start - embargo rows, so their positives
    are the running sum at the last of them.
    """
    ranked = df.select(*by, ts.row_index(by, order).alias("row"), F.sum(F.coalesce(F.col(target), F.lit(0))).over(ts.spec(by, order).rowsBetween(Window.unboundedPreceding, 0)).alias("train_positives"))
    folds = fold_table(df, min_train, test, 0, by).select(*by, "fold", "start", "test_rows", F.explode(F.array(*[F.lit(int(e)) for e in embargoes])).alias("embargo"))
    folds = folds.withColumn("train_rows", F.greatest(F.col("start") - F.col("embargo"), F.lit(0))).withColumn("row", F.col("train_rows") - 1)
    met = folds.join(ranked, [*by, "row"], "left")
    return met.select(*by, "embargo", "fold", F.col("train_rows").cast("long").alias("train_rows"), F.col("test_rows").cast("long").alias("test_rows"), F.coalesce("train_positives", F.lit(0)).cast("long").alias("train_positives"))
