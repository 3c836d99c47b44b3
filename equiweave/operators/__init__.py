"""Relational operators on keyed DataFrames."""
