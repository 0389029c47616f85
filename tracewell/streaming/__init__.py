"""Incremental refresh on Structured Streaming triggers."""
