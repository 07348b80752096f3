"""Readers, table stores and writers."""
