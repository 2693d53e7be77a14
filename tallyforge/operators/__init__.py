"""Operators: each takes DataFrames and returns DataFrames with fixed schemas."""
