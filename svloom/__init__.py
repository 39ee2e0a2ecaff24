"""Structural-variant analytics on Spark DataFrames."""
