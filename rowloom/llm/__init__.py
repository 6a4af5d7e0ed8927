"""Operators of a training-data pipeline: token counts, mixing, deduplication, extraction, filtering, sharding, formatting."""
