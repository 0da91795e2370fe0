"""Continuous query traffic over a static index."""
