"""Operators: DataFrames in, DataFrame out, no driver-side row loops."""
