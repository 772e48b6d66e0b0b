"""Sensitive-span detection and masking on Spark DataFrames."""
