"""Operators: DataFrames in, DataFrames out, keyed by ``query_id``."""
