"""Operators of a training-data pipeline over document tables, each in a module of its own."""
