"""What a pipeline reads: a DataFrame with an order key, or Python values pulled from an iterable on the driver."""

from __future__ import annotations

import asyncio
import itertools
from collections.abc import AsyncIterable, AsyncIterator, Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PipelineBuildError

#: Scalar Python types and the column types that carry them unchanged; all else travels pickled.
PLAIN = {int: "long", float: "double", str: "string", bool: "boolean", bytes: "binary"}
#: Beginning of the names of order keys and the like; no table may have such columns.
OWN = "__brooklet_"
POS = f"{OWN}pos"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def normalised(source):
    """An iterator over a source: iterables spread; dict, str, bytes, None and other values are one element."""
    if isinstance(source, (dict, str, bytes)):
        return iter([source])
    if isinstance(source, AsyncIterable) or hasattr(source, "__anext__"):
        return _drained(source)
    if isinstance(source, Iterable):
        return iter(source)
    if hasattr(source, "__next__"):
        return _pulled(source)
    return iter([source])


def _pulled(source):
    while True:
        try:
            yield next(source)
        except StopIteration:
            return


def _drained(source):
    """Elements of an asynchronous feed, one pull at a time, closed at the end."""
    loop = asyncio.new_event_loop()
    it: AsyncIterator = source.__aiter__() if hasattr(source, "__aiter__") else source
    try:
        while True:
            try:
                yield loop.run_until_complete(it.__anext__())
            except StopAsyncIteration:
                return
    finally:
        if hasattr(it, "aclose"):
            loop.run_until_complete(it.aclose())
        loop.close()


class FrameSource:
    """A DataFrame; order_by names columns that give the encounter order (a unique key), else the file's own row order."""

    native, bounded = True, True

    def __init__(self, df: DataFrame, order_by=None):
        self.df, self.order_by = df, [order_by] if isinstance(order_by, str) else list(order_by or ())
        self.names = df.columns
        if taken := [c for c in df.columns if c.startswith(OWN)]:
            raise PipelineBuildError(f"rename the columns {taken}: names that begin with {OWN} are taken")

    def frame(self, pos: bool, bound: int | None = None):
        """(DataFrame, kind); pos is added only where a step or terminal needs it, as Catalyst can't remove it again."""
        if not pos:
            return self.df, "record"
        if self.order_by:
            key = F.col(self.order_by[0]) if len(self.order_by) == 1 else F.struct(*self.order_by)
            return self.df.withColumn(POS, key), "record"
        try:
            at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
            return self.df.select("*", at.alias(POS)), "record"
        except Exception as e:
            raise PipelineBuildError("this source has no row order of its own; name order_by") from e


class LocalSource:
    """Python values. They are pulled once; with a known bound no more than that are pulled. lazy: pulled from a generator,
    an iterator or a feed, whose end may be far or nowhere; endless ones aren't bounded."""

    native = False

    def __init__(self, items, bounded: bool = True, lazy: bool = False):
        self.items, self.bounded, self.lazy = items, bounded, lazy or not bounded

    def chunks(self, first: int = 16, most: int = 8192):
        """Lists of elements, each twice as long as the one before. What the source raises comes after what it gave before."""
        size = first
        try:
            while True:
                out, failed = [], None
                try:
                    for x in itertools.islice(self.items, size):
                        out.append(x)
                except Exception as e:
                    failed = e
                if out:
                    yield out
                if failed is not None:
                    raise failed
                if len(out) < size:
                    return
                size = min(2 * size, most)
        finally:
            if hasattr(self.items, "close"):
                self.items.close()

    def pull(self, bound: int | None) -> list:
        if bound is None and not self.bounded:
            raise PipelineBuildError("an endless source needs a limit before this terminal")
        return list(self.items if bound is None else itertools.islice(self.items, bound))

    def frame(self, pos: bool, bound: int | None = None):
        values = self.pull(bound)
        kinds = {type(v) for v in values if v is not None}
        spark = session()
        if len(kinds) == 1 and (kind := PLAIN.get(next(iter(kinds)))) and not (kind == "long" and any(v is not None and not -(1 << 63) <= v < 1 << 63 for v in values)):
            return spark.createDataFrame(list(enumerate(values)), f"{POS} long, v {kind}"), "column"
        rows = [(i, cloudpickle.dumps(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, f"{POS} long, v binary"), "pickle"


def iterated(seed, step):
    while True:
        yield seed
        seed = step(seed)
