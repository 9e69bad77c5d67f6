"""Relational operators as functions over DataFrames."""
