"""Operators of a training-data pipeline, one module each; queries.py names the queries over the driver tables."""
