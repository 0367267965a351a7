"""Tidemark: event-market and news analytics expressed as Spark DataFrames."""
