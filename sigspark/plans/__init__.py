"""Measurements, processing plans, their checks and their execution."""
