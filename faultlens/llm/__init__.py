"""Operators for preparing training data: hashing, filtering, deduplication, mixing, sharding."""
