"""Column-in, column-out expressions; no Python runs per row."""
