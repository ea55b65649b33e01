"""Structured Streaming jobs built from the batch operators."""
