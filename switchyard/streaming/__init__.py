"""Structured Streaming versions of the monitoring aggregates."""
