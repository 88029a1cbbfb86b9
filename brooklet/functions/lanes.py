"""Three lanes for callables: Column expressions, Python over Arrow batches, and async with bounded concurrency.

A callable's lane is chosen when its step is lowered. Table sources try a plain function as a Column function of the
element first; sources of Python values run it as Python, so that Python's own arithmetic holds.
"""

from __future__ import annotations

import asyncio
import functools
import inspect
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import carried

#: Calls in flight at once in the async lane.
CONCURRENCY = 4


@dataclass(frozen=True)
class py:  # noqa: N801
    """Mark a function for the Python lane; returns is the Spark type of its results, else they are carried pickled."""

    fn: object
    returns: str | None = None


@dataclass(frozen=True)
class aio:  # noqa: N801
    """Mark a function for the async lane with its own bound of concurrent calls."""

    fn: object
    returns: str | None = None
    concurrency: int = CONCURRENCY


@dataclass(frozen=True)
class col:  # noqa: N801
    """Mark a function as a Column function, whatever the source."""

    fn: object


class Element:
    """What a Column function gets for a record: fields as attributes or items."""

    def __init__(self, names):
        self._names = tuple(names)

    def __getattr__(self, name):
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return F.col(f"`{name}`")

    def __getitem__(self, name):
        if name not in self._names:
            raise KeyError(name)
        return F.col(f"`{name}`")


def is_async(fn) -> bool:
    while isinstance(fn, functools.partial):
        fn = fn.func
    return inspect.iscoroutinefunction(fn) or inspect.iscoroutinefunction(getattr(fn, "__call__", None))


def resolve(fn, element, native: bool):
    """('column', expression) or ('python', fn, returns, concurrency); concurrency 0 is the plain Python lane."""
    if isinstance(fn, Column):
        return "column", fn
    if isinstance(fn, str):
        return "column", F.expr(fn)
    if isinstance(fn, col):
        return "column", _columns(fn.fn(element))
    if isinstance(fn, py):
        return "python", fn.fn, fn.returns, CONCURRENCY if is_async(fn.fn) else 0
    if isinstance(fn, aio):
        return "python", fn.fn, fn.returns, fn.concurrency
    if not callable(fn):
        raise TypeError(f"not a callable or a Column: {fn!r}")
    if is_async(fn):
        return "python", fn, None, CONCURRENCY
    if native:
        try:
            got = fn(element)
        except Exception:  # no Column function: it runs as Python
            got = None
        if isinstance(got, Column) or (isinstance(got, dict) and got and all(isinstance(v, Column) for v in got.values())):
            return "column", _columns(got)
    return "python", fn, None, 0


def _columns(got):
    if isinstance(got, dict):
        return F.struct(*(v.alias(k) for k, v in got.items()))
    return got if isinstance(got, Column) else F.lit(got)


def truthy(c: Column, kind) -> Column:
    """Python's truth of a column: null, zero and empty are false."""
    from pyspark.sql import types as T

    if isinstance(kind, T.BooleanType):
        out = c
    elif isinstance(kind, (T.NumericType)):
        out = c != 0
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        out = F.length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        out = F.size(c) > 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def called(fn, items: list, concurrency: int) -> list:
    """Results of fn over items, in their order; awaitables run at most `concurrency` at once. For executors: what fn
    raises travels to the driver."""
    with carried():
        return results(fn, items, concurrency)


def results(fn, items: list, concurrency: int) -> list:
    if not concurrency:
        out = [fn(x) for x in items]
        if not any(inspect.isawaitable(x) for x in out):
            return out

        async def wait_all():
            return [await x if inspect.isawaitable(x) else x for x in out]

        return asyncio.run(wait_all())

    async def run():
        gate = asyncio.Semaphore(concurrency)

        async def one(x):
            async with gate:
                got = fn(x)
                return await got if inspect.isawaitable(got) else got

        return await asyncio.gather(*(one(x) for x in items))

    return asyncio.run(run())
