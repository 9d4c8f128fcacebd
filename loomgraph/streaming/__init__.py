"""Structured Streaming: history that arrives in pieces."""
