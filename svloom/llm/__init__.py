"""Operators for large training-text corpora.

Nothing outside this folder imports it.  Every operator takes DataFrames and
column names and returns a DataFrame; ``queries`` binds them to the synthetic
tables under fixed output contracts.
"""
