"""Operators for building training corpora: search, packing, deduplication, extraction, sharding, archives."""
