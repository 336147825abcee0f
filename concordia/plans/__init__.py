"""Registered queries, by area; importing this package registers them all."""

from . import admin, curation, discovery, journal, quality, relational, resolution, review, search, sources, taxonomy  # noqa: F401
