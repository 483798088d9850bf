"""Readers, writers and reuse of results."""
