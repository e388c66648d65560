"""Spark-native conversion, profiling and evaluation of semi-structured records."""

__version__ = "0.1.0"
