"""Spark-native URL risk analytics and data-preparation operators."""

__version__ = "0.1.0"
