"""Groundline operators."""
