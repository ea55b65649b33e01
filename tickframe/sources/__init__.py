"""Readers and writers of the lake tables and message frames."""
