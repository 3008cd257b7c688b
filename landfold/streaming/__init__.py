"""Structured Streaming operators and the runs that drive them over a table folder."""
