"""Groundline streaming."""
