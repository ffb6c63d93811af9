"""Names, types and column helpers of series frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARKET = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("price", T.DoubleType()), T.StructField("return", T.DoubleType())])
MARKET_WITH_REGIME = T.StructType([*MARKET.fields, T.StructField("regime", T.IntegerType())])
#: Prefixes that mark a column as a model input.
FEATURE_PREFIXES = ("return_lag", "momentum", "volatility", "drawdown")
REGIME_PREFIX = "regime_prob_"


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs of a feature frame, by prefix, in frame order."""
    return [c for c in df.columns if c.startswith(FEATURE_PREFIXES)]


def regime_columns(df: DataFrame) -> list[str]:
    """Regime probability columns in the order of their number."""
    return sorted((c for c in df.columns if c.startswith(REGIME_PREFIX)), key=lambda c: int(c.removeprefix(REGIME_PREFIX)))


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df
