"""Operators of a training-data pipeline: scoring, deduplication, tokens, packing and search."""
