"""Papyrine: document indexing and retrieval on Spark DataFrames."""
