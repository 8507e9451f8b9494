"""Operators: DataFrames in, DataFrames out; nothing is collected except K x K results."""
