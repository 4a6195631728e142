"""Spark-first annotation analytics over time-ordered episodes."""

__version__ = "0.1.0"
