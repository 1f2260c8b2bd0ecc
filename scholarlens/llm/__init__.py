"""Operators of a training-data pipeline, with their queries and SQL."""
