"""Wearable-metrics warehouse on Spark: DataFrames in, DataFrames out, every key led by ``user_id``."""
