"""Column-building functions."""
