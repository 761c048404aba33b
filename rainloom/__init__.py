"""Rainloom: a PySpark-native engine for particle-spectrum time series."""

__version__ = "0.1.0"
