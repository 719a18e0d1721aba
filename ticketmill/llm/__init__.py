"""Operators for training data: near duplicates, sharding, filters, packing, search, tokens."""
