"""Segment-level text processing and corpus preparation on Spark DataFrames."""
