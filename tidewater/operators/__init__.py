"""Relational, row-change, time-series and market operators, each from DataFrames to a DataFrame."""
