"""Column builders: each function maps columns to a column, with no action."""
