"""Exact pattern search over token streams, and what a training-data pipeline needs, on Spark."""
