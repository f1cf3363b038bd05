"""Structured Streaming forms of the event and preparation chains."""
