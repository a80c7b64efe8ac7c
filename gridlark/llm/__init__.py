"""Operators for training-data corpora: dedup, filters, tokens, packing, search."""
