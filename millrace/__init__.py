"""Millrace: a PySpark-native engine for text, conversation and graph data."""

__version__ = "0.1.0"
