"""Operators of a training-data pipeline: scoring, deduplication, cleaning, packing, counting."""
