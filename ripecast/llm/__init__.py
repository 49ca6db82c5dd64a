"""Operators for preparing training text: scoring, filtering, deduplication, mixing and sharding."""
