"""Operators that prepare training data: deduplication, scoring, mixing, encoding."""
