"""Operators on register tables: each a function from DataFrames to DataFrames."""
