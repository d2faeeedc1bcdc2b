"""Runnable queries over the given tables."""
from . import duplicates, feeds, pages, payloads, scalars, snapshots, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
