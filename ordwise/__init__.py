"""Positional array analytics on Spark: bulk array operators as DataFrame transformations."""
