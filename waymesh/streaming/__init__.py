"""Structured Streaming triggers."""
