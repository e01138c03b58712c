"""Operators for training-data pipelines: cleaning, deduplication, scoring, counting and packing of text."""
