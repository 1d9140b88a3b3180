"""Daily market research on Spark: bars, features, factor tests and book figures."""

__version__ = "0.1.0"
