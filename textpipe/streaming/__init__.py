"""Pipelines under Structured Streaming."""
