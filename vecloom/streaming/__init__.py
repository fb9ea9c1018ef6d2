"""Streams of queries against a static index (an extra)."""

from .search import stream_search

__all__ = ["stream_search"]
