"""Operators for preparing training text: deduplication, filtering, tokenizing, sharding."""
