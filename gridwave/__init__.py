"""Sparse matrices, grid walks and probability tables as Spark DataFrames."""
