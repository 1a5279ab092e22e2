"""Structured Streaming forms of intake and progress."""
