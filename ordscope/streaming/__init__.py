"""Structured Streaming forms of the shard jobs."""
