"""Structured Streaming index maintenance."""
