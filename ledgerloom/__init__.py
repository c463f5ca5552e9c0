"""Ledgerloom: a Spark-native analytics engine for source-grounded memory ledgers."""

__version__ = "0.1.0"
