"""Millrace: a PySpark-native engine for profiling, repairing, reshaping and modelling tabular data."""

__version__ = "0.1.0"
