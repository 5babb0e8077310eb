"""Readers and writers of linkage data."""
