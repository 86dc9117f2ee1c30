"""Operators over cells and DataFrames."""
