"""Operators of a training-data pipeline: deduplication, packing, scoring, mixing."""
