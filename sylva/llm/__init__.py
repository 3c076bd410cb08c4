"""Operators for building training data: media, scoring, sharding, scans, packing, deduplication and mixing."""
