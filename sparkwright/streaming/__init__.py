"""Incremental loads of files that arrive."""

from sparkwright.streaming.arrivals import drain, windowed_counts

__all__ = ["drain", "windowed_counts"]
