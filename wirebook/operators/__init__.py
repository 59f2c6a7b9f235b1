"""Batch operators: DataFrames in, DataFrames out, nothing collected."""
