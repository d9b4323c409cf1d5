"""Operators for preparing training data: archives, deduplication, quality, tokens, mixing, private data."""
