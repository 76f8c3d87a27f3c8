"""Spark-native text analytics for graded reading corpora."""

__version__ = "0.1.0"
