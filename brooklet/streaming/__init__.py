"""Pipelines over Structured Streaming."""

from .batches import for_each_batch, stream_frame

__all__ = ["for_each_batch", "stream_frame"]
