"""Readers and writers: tables, rules, settings, caches and report files."""
