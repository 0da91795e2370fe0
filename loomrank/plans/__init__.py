"""Whole plans that users call: build, search, measure."""
