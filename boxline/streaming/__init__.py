"""Structured Streaming jobs over frame tables."""
