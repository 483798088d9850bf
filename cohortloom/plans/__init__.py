"""Composed analyses and the query catalogue."""
