"""Keyed changelog analytics on Spark."""
