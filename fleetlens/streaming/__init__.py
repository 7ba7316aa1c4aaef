"""Streaming forms of the polled reports, on Structured Streaming."""
