"""Operators for training-data pipelines: cleaning, deduplication, tokens, search and extraction."""
