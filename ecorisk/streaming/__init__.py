"""Incremental folding of new data."""
