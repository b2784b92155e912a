"""Scores, windows, statistics and diagnostics as DataFrame transformations."""
