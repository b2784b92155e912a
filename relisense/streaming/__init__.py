"""Windowed aggregation of live signals with fitted score models."""
