"""Ordered data-parallel pipelines over Spark DataFrames."""
