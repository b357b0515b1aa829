"""Operators on point maps, each a function from DataFrames to a DataFrame."""
