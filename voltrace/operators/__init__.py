"""Relational operators: DataFrames in, DataFrames out, with the time passed in."""
