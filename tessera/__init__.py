"""Tessera: a Spark-native engine for spatial analytics over DataFrames."""

__version__ = "0.1.0"
