"""Callables: lanes that run them, and comparators."""

from .comparators import Comparator, by, natural
from .lanes import Element, aio, col, py, resolve

__all__ = ["Comparator", "Element", "aio", "by", "col", "natural", "py", "resolve"]
