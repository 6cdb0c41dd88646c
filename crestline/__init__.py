"""Density-peaks clustering and its evaluation on Spark DataFrames."""
