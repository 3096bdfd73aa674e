"""Operators over event logs, each a function from DataFrames to DataFrames."""
