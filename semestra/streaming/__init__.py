"""Structured Streaming twin of the attendance statistics."""
