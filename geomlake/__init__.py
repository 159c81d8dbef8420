"""Representational analytics on Spark DataFrames."""
