"""Operators that prepare training text: deduplication, tokenizers, extraction, packing, scoring, sharding."""
