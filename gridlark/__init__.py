"""Spark-native panel forecasting data work and order-message controls."""

__version__ = "0.1.0"
