"""Operators on DataFrames: each takes DataFrames and returns one, and computes nothing by itself unless it says so."""
