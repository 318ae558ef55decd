"""Structured Streaming forms of the review loop."""
