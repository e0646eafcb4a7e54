"""Sequence, feature and taxonomy analytics on Spark DataFrames."""
