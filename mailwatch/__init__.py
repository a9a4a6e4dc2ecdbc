"""Spark-native operators for mail classification data and model monitoring."""

__version__ = "0.1.0"
