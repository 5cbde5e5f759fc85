"""Sparse linear algebra, multigrid and corpus processing on Spark DataFrames."""
