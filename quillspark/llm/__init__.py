"""Operators for building training data: filtering, deduplication, mixing and packing."""
