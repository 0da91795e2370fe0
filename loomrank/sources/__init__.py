"""Readers: text, CIFF files, query files, requests, stored indexes."""
