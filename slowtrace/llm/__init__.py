"""Preparation of training text: quality, duplicates, personal data, packing, extraction, sharding, contamination."""
