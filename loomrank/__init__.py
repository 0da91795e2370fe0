"""Ranked retrieval on Spark: impact-ordered indexes and budgeted top-k search as DataFrame plans."""
