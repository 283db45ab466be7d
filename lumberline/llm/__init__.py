"""Operators for training-data pipelines: dedup, scoring, tokens, packing, archives, search, chat formatting."""
