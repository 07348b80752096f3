"""Incremental ingest and staged answers."""
