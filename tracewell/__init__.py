"""Spark-native evidence, call-graph and reachability analytics."""

__version__ = "0.1.0"
