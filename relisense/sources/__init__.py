"""Readers and writers for the studies' file layouts."""
