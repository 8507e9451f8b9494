"""Incremental versions of the panel aggregates on Structured Streaming."""
