"""Groundline plans."""
