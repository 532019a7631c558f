"""Operators for training-data pipelines: scoring, search, deduplication, filtering, tokens."""
