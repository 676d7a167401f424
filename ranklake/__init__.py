"""Ranked text retrieval and retrieval analytics on Spark DataFrames."""
