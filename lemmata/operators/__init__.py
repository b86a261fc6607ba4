"""Rulebases and sessions: facts in, rules fired, queries out."""
