"""Structured Streaming versions of the main queries."""
