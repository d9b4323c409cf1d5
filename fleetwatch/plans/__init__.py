"""Ordered-per-key building blocks that stay balanced when one key is huge."""
