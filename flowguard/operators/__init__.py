"""Operators on DataFrames: aggregation, joins, windows and state."""
