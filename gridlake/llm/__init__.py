"""Operators for large text corpora: quality, deduplication, packing, tokenising, scoring and archives."""
