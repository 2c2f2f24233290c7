"""Operators over DataFrames of arguments."""
