"""Sources: tables, Python values, generators, asynchronous feeds, files."""

from .sources import FrameSource, LocalSource, normalised, session

__all__ = ["FrameSource", "LocalSource", "normalised", "session"]
