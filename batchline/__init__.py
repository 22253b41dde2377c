"""Warehouse loading, lineage and run-log work as Spark jobs."""
