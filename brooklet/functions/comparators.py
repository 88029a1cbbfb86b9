"""Comparators: keys that Catalyst can sort by, or three-way functions for everything else."""

from __future__ import annotations

import asyncio
import inspect
from dataclasses import dataclass

from ..errors import carried


@dataclass(frozen=True)
class Comparator:
    """keys: (selector, descending); a selector is a column name, a Column or a function of the element."""

    keys: tuple[tuple[object, bool], ...]

    def then(self, selector, desc: bool = False) -> Comparator:
        return Comparator((*self.keys, (selector, desc)))

    def reversed(self) -> Comparator:
        return Comparator(tuple((s, not d) for s, d in self.keys))


def by(selector, desc: bool = False) -> Comparator:
    return Comparator(((selector, desc),))


natural = Comparator(((lambda v: v, False),))


def three_way(compare, a, b) -> int:
    """Sign of an opaque comparator; exactly int is allowed, bool isn't."""
    sign = compare(a, b)
    if inspect.isawaitable(sign):
        sign = asyncio.run(_wait(sign))
    if type(sign) is not int:
        raise TypeError(f"a comparator must return int, not {type(sign).__name__}")
    return sign


async def _wait(x):
    return await x


class Ranked:
    """Sort key of an opaque comparator: picklable, ties by position."""

    __slots__ = ("compare", "item", "at")

    def __init__(self, compare, item, at):
        self.compare, self.item, self.at = compare, item, at

    def __lt__(self, other):
        with carried():
            sign = three_way(self.compare, self.item, other.item)
        return sign < 0 or (sign == 0 and self.at < other.at)

    def __reduce__(self):
        return Ranked, (self.compare, self.item, self.at)
