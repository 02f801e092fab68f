"""Operators over samples, frames and intervals, as DataFrame functions."""
