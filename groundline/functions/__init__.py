"""Groundline functions."""
