"""Indexing of arriving batches."""
