"""Readers, writers and views that present tables as signals."""
