"""Table creation and idempotent writes."""
