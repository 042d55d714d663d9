"""Spark-native validation of document extraction at corpus scale."""

__version__ = "0.1.0"
