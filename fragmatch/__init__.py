"""Spark-native search for small copied fragments in large collections."""

__version__ = "0.1.0"
