"""Spark-native preparation, forecasting and evaluation of many time series."""

__version__ = "0.1.0"
