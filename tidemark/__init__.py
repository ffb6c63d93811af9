"""tidemark: a PySpark-native engine for time-series research and corpus preparation."""

__version__ = "0.1.0"
