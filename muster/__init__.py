"""Frozen, reproducible identifier lists for many datasets at once, on Spark."""

__version__ = "0.1.0"
