"""Readers and writers for texts."""
