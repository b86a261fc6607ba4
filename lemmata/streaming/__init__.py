"""Structured Streaming in front of sessions."""
