"""Readers, writers and the views that stand in for real shop data."""
