"""Relational steps of building and searching an index."""
