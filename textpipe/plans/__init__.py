"""Pipelines as data: configuration, validation, planning."""
