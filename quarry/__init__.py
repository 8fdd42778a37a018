"""Quarry: document analytics, retrieval evaluation and corpus cleaning on Spark DataFrames."""

__version__ = "0.1.0"
