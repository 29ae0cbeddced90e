"""Incremental (resumable) operators on Structured Streaming (ST1-ST5)."""
