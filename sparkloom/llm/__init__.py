"""Operators of a training-data pipeline: dedup, quality, tokenising, archives, mixing, safety."""
