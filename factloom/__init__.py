"""Temporal-fact analytics on Spark DataFrames."""
