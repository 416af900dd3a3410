"""Operators of a training-data pipeline, their queries and the SQL twins of these."""
