"""Operators for preparing large text corpora: tokens, deduplication, packing, sharding, scoring and search."""
