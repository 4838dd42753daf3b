"""Spindle: a PySpark-native engine for time-ordered media features and text corpora."""

__version__ = "0.1.0"
