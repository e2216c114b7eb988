"""Spark-native analytics over a media and document catalogue."""

__version__ = "0.1.0"
