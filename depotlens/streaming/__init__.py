"""Structured Streaming forms of two batch operators (same final tables)."""
