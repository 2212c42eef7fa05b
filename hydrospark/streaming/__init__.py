"""Incremental arrival of tiles through Structured Streaming."""
