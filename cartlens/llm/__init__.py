"""Operators for training-data pipelines: filters, deduplication, tokens and fingerprints over document tables."""
