"""Corvane: code-and-text analytics on Spark DataFrames."""
