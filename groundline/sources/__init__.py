"""Groundline sources."""
