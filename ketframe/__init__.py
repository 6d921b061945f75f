"""Sparse quantum linear algebra as relational data processing on PySpark DataFrames."""

__version__ = "0.1.0"
