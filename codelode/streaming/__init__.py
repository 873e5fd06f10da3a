"""Structured Streaming forms of the index and of run status."""
