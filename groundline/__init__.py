"""Groundline: document evidence as Spark DataFrame and Structured Streaming jobs."""
