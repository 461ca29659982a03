"""Operators: each takes DataFrames (or a star) and returns a DataFrame."""
