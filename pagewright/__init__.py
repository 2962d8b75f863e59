"""Spark-first document, retrieval and vector analytics."""

__version__ = "0.1.0"
