"""Incremental batches and streams."""
