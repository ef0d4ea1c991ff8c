"""Operators on model tables, each a function from DataFrames to a DataFrame."""
