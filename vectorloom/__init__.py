"""Spark-native clustering of dense vectors and signed graphs."""

__version__ = "0.1.0"
