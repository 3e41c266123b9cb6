"""Versioned key-value, full-text, vector and retrieval analytics on Spark DataFrames."""
