"""Operators for building training data: scoring, filtering, deduplication, mixing, packing, sharding, archives."""
