"""Sorting, verification and benchmark analytics on DataFrames."""
