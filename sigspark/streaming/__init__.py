"""Measurements over unbounded signals."""
