"""Operators over lineage, documents and run logs."""
