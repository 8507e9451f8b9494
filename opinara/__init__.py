"""Spark-native analytics over opinion panels: long facts in, DataFrames out."""

__version__ = "0.1.0"
