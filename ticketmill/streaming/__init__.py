"""Structured Streaming versions of the continuously updated tables."""
