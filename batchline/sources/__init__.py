"""Readers: dropped files, databases and metadata lookups."""
