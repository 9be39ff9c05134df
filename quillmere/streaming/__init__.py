"""Structured Streaming versions of the log operators."""
