"""Spark-native purchase-history recommendation, catalogue search and corpus preparation."""

__version__ = "0.1.0"
