"""Pipelines over DataFrames: by cell, by line, as SQL functions."""
