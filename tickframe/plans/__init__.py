"""Operators composed into the bronze, silver, gold and metrics tables."""
