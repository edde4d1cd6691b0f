"""Readers of other document formats: each gives the text of its pages, and a few metadata."""
