"""Batch-incremental jobs on Structured Streaming."""
