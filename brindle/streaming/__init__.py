"""Incremental forms of the event aggregates."""
