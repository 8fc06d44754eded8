"""Structured Streaming variants of the frame operators."""
