"""Readers of pages and seed files, and idempotent sinks."""
