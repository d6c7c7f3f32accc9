"""Structured Streaming scorer (stateless: the batch scorer on a stream)."""
