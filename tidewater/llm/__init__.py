"""Operators for building training data: filtering, deduplication, mixing, archives and search."""
