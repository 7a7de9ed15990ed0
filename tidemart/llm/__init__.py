"""Operators for training-data pipelines: secrets, near-duplicates, tokens, language, quality, packing."""
