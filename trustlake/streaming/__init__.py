"""Structured Streaming forms of the record checks."""
