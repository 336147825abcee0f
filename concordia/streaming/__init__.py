"""Structured Streaming: deduplication, funnels and daily counts under watermarks."""
