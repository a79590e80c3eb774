"""Spark-native passage retrieval, evaluation and corpus preparation."""

__version__ = "0.1.0"
