"""Structured Streaming forms of fact maintenance."""
