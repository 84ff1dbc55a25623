"""Similarity search and embedding catalogs on Spark DataFrames."""
