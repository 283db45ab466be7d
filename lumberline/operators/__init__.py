"""Operators on log lines: each takes and returns DataFrames."""
