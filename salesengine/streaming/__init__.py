"""Structured Streaming jobs."""

from salesengine.streaming.load import start_append_stream

__all__ = ["start_append_stream"]
