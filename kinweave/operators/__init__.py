"""Linkage operators; each takes and returns DataFrames."""
