"""Structured Streaming jobs; each has a batch twin over the same rows."""
