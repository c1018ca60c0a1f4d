"""Structured Streaming over growing results."""
