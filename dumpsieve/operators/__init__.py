"""Operators over DataFrames of lines."""
