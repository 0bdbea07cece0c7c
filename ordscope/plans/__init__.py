"""Compositions that users call."""
