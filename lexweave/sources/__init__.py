"""Readers: everything returns a DataFrame with a declared schema."""
