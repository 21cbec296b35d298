"""Operators for large text corpora: deduplication, filtering, mixing, sanitising and scoring."""
