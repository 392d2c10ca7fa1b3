"""Queries: operators bound to tables."""
