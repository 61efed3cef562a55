"""Structured Streaming counterparts of the daily aggregations."""
