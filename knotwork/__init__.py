"""Smooth-model analytics on Spark."""
