"""Collector factories.

A native collector turns the element (a Column or an Element) and the order key into one aggregate Column, so nested
collectors compile to a single aggregation with partial sums below its shuffle. Where a part is no Column function, the
same collector folds in Python: `fold` gives supplier, accumulator and finisher.
"""

from __future__ import annotations

import inspect
from collections import namedtuple
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PipelineBuildError
from ..functions.comparators import Comparator, natural, three_way
from ..functions.lanes import Element, resolve

SummaryStatistics = namedtuple("SummaryStatistics", "count sum min max average")
NONE = object()


class NotNative(Exception):
    """A part of a collector is opaque Python."""


def expr(fn, element) -> Column:
    got = resolve(fn, element, native=True)
    if got[0] != "column":
        raise NotNative
    return got[1]


def whole(element) -> Column:
    return F.struct(*(element[n].alias(n) for n in element._names)) if isinstance(element, Element) else element


@dataclass(frozen=True)
class Order:
    """A group's encounter order: ascending key, and the same key turned round where it is a number; frame: what both belong to."""

    up: Column
    down: Column | None = None
    frame: DataFrame | None = None


def ordered(value: Column, pos: Order) -> Column:
    """Values of a group in encounter order, nulls kept: one array, so it must fit a row."""
    return F.array_sort(F.collect_list(F.struct(pos.up.alias("p"), value.alias("v"))))["v"]


class Collector:
    """A mutable reduction of one's own: supplier() -> container, accumulator(container, element), finisher(container).

    The combiner is called by unordered pipelines only, which fold each partition where it lies: combiner(a, b) gives the
    result or puts b into a. Ordered collection is one left fold.
    """

    needs_order = True

    def __init__(self, supplier, accumulator, combiner=None, finisher=None):
        self.supplier, self.accumulator, self.combiner, self.finisher = supplier, accumulator, combiner, finisher

    def column(self, element, pos) -> Column:
        raise NotNative

    def fold(self):
        return self.supplier, self.accumulator, self.finisher

    def value(self, got):
        """The Python result for the value of column()."""
        return got


@dataclass
class Native(Collector):
    """build(element, pos) -> aggregate Column; start/add/end fold the same in Python."""

    build: object
    start: object
    add: object
    end: object = None
    convert: object = None
    needs_order: bool = False
    combiner: object = field(default=None)

    def column(self, element, pos):
        return self.build(element, pos)

    def fold(self):
        return self.start, self.add, self.end

    def value(self, got):
        return self.convert(got) if self.convert else got


async def _settled(x):
    return await x if inspect.isawaitable(x) else x


def _cell():
    return [NONE]


def to_list() -> Collector:
    return Native(lambda e, p: ordered(whole(e), p), list, lambda c, x: c.append(x), needs_order=True)


def to_set() -> Collector:
    return Native(lambda e, p: F.collect_set(F.struct(whole(e).alias("v")))["v"], set, lambda c, x: c.add(x), convert=set)


def to_collection(supplier) -> Collector:
    """A container of supplier's, filled by add() in encounter order."""
    return Collector(supplier, lambda c, x: c.add(x))


def joining(delimiter: str = "", prefix: str = "", suffix: str = "") -> Collector:
    def build(e, p):
        bad = F.raise_error(F.lit("joining needs strings"))
        checked = F.when(e.isNull(), bad).otherwise(e)
        return F.concat(F.lit(prefix), F.coalesce(F.array_join(ordered(checked, p), delimiter), F.lit("")), F.lit(suffix))

    return Native(build, list, lambda c, x: c.append(x), lambda c: prefix + delimiter.join(c) + suffix, needs_order=True)


def counting() -> Collector:
    return Native(lambda e, p: F.count(F.lit(1)), lambda: [0], lambda c, x: c.__setitem__(0, c[0] + 1), lambda c: c[0])


def _wide(c: Column, p: Order) -> Column:
    """Whole numbers as decimals, so that sums have 30 digits; anything else as it is."""
    whole_ = p.frame is not None and isinstance(p.frame.select(c.alias("c")).schema["c"].dataType, T.IntegralType)
    return c.cast("decimal(20,0)") if whole_ else c


def _int(v):
    """Decimals without a fraction digit are Python's ints."""
    return int(v) if isinstance(v, Decimal) and v.as_tuple().exponent == 0 else v


def _sum(mapper, cast, zero):
    def build(e, p):
        c = expr(mapper, e)
        return F.coalesce(F.sum(c.cast(cast) if cast else _wide(c, p)), F.lit(zero))

    def add(c, x):
        v = mapper(x)
        c[0] += float(v) if cast == "double" else v

    return Native(build, lambda: [zero], add, lambda c: c[0], convert=_int)


def summing_int(mapper) -> Collector:
    return _sum(mapper, None, 0)


summing_long = summing_int


def summing_double(mapper) -> Collector:
    return _sum(mapper, "double", 0.0)


def averaging_double(mapper) -> Collector:
    def add(c, x):
        c[0] += 1
        c[1] += float(mapper(x))

    return Native(lambda e, p: F.coalesce(F.avg(expr(mapper, e).cast("double")), F.lit(0.0)), lambda: [0, 0.0], add, lambda c: c[1] / c[0] if c[0] else 0.0)


averaging_int = averaging_long = averaging_double


def _summary(mapper, cast):
    def build(e, p):
        c = expr(mapper, e)
        c = c.cast(cast) if cast else c
        return F.struct(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(c if cast else _wide(c, p)), F.lit(0.0 if cast else 0)).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"), F.coalesce(F.avg(c), F.lit(0.0)).alias("average"))

    def add(c, x):
        v = float(mapper(x)) if cast else mapper(x)
        c[0] += 1
        c[1] += v
        c[2] = v if c[2] is None or v < c[2] else c[2]
        c[3] = v if c[3] is None or v > c[3] else c[3]

    return Native(build, lambda: [0, 0.0 if cast else 0, None, None], add, lambda c: SummaryStatistics(*c, float(c[1]) / c[0] if c[0] else 0.0), convert=lambda r: SummaryStatistics(*map(_int, r)))


def summarizing_int(mapper) -> Collector:
    return _summary(mapper, None)


summarizing_long = summarizing_int


def summarizing_double(mapper) -> Collector:
    return _summary(mapper, "double")


def _extreme(comparator, sign):
    comparator = natural if comparator is None else comparator

    def build(e, p):
        if not isinstance(comparator, Comparator) or len({d for _, d in comparator.keys}) > 1:
            raise NotNative
        keys = [expr(s, e) for s, _ in comparator.keys]
        least = (sign < 0) != comparator.keys[0][1]
        # The first of ties wins in both, so the order key breaks them upwards for the least and turned round for the greatest.
        if least:
            return F.min_by(whole(e), F.struct(*keys, p.up))
        if p.down is None:
            raise NotNative
        return F.max_by(whole(e), F.struct(*keys, p.down))

    def add(c, x):
        if c[0] is NONE:
            c[0] = x
        else:
            s = _compare(comparator, x, c[0])
            if s * sign > 0:
                c[0] = x

    return Native(build, _cell, add, lambda c: None if c[0] is NONE else c[0], needs_order=True)


def _compare(comparator, a, b) -> int:
    if not isinstance(comparator, Comparator):
        return three_way(comparator, a, b)
    for selector, desc in comparator.keys:
        get = selector if callable(selector) else (lambda x, s=selector: x[s])
        x, y = get(a), get(b)
        if x != y:
            return (-1 if x < y else 1) * (-1 if desc else 1)
    return 0


def min_by(comparator=None) -> Collector:
    return _extreme(comparator, -1)


def max_by(comparator=None) -> Collector:
    return _extreme(comparator, 1)


def reducing(*args) -> Collector:
    """reducing(op), reducing(identity, op) or reducing(identity, mapper, op): an ordered left fold."""
    if not 1 <= len(args) <= 3:
        raise TypeError("reducing takes op, identity and op, or identity, mapper and op")
    op = args[-1]
    identity = args[0] if len(args) > 1 else NONE
    mapper = args[1] if len(args) == 3 else (lambda x: x)

    def build(e, p):
        values = ordered(whole(e) if len(args) < 3 else expr(mapper, e), p)
        try:
            if not isinstance(op(F.lit(1), F.lit(1)), Column):
                raise NotNative
        except NotNative:
            raise
        except Exception as e_:
            raise NotNative from e_
        if identity is not NONE:
            return F.aggregate(values, F.lit(identity), op)
        rest = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
        return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)), op))

    def add(c, x):
        x = mapper(x)
        c[0] = x if c[0] is NONE else op(c[0], x)

    return Native(build, lambda: [identity], add, lambda c: None if c[0] is NONE else c[0], needs_order=True)


def to_map(key, value, merge=None) -> Collector:
    return ToMap(key, value, merge)


class ToMap(Collector):
    """Keys and values; a second value for a key is an error without merge, else merge(existing, new) in encounter order."""

    def __init__(self, key, value, merge):
        self.key, self.val, self.merge = key, value, merge
        super().__init__(dict, self._add)

    def _add(self, c, x):
        k, v = self.key(x), self.val(x)
        if k not in c:
            c[k] = v
        elif self.merge is None:
            raise ValueError(f"Duplicate key: {k}")
        else:
            c[k] = self.merge(c[k], v)

    def group(self, element):
        if self.merge is None:
            def build(e, p):
                twice = F.raise_error(F.lit("Duplicate key"))
                return F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(expr(self.val, e)))

            return [expr(self.key, element)], Native(build, None, None)
        return [expr(self.key, element)], mapping(self.val, reducing(self.merge))


class Grouping(Collector):
    """One result of downstream for each key of classifier; nests to several keys."""

    def __init__(self, classifier, downstream, both: bool = False):
        if not isinstance(downstream, Collector):
            raise PipelineBuildError("a collector is needed downstream")
        self.classifier, self.downstream, self.both = classifier, downstream, both
        super().__init__(dict, None)

    def fold(self):
        start, add, end = self.downstream.fold()

        def step(c, x):
            k = bool(self.classifier(x)) if self.both else self.classifier(x)
            if k not in c:
                c[k] = start()
            return add(c[k], x)

        def supply():
            return {True: start(), False: start()} if self.both else {}

        return supply, step, lambda c: {k: end(v) if end else v for k, v in c.items()}


def grouping_by(classifier, downstream=None) -> Collector:
    return Grouping(classifier, to_list() if downstream is None else downstream)


def partitioning_by(predicate, downstream=None) -> Collector:
    """Always the keys True and False."""
    return Grouping(predicate, to_list() if downstream is None else downstream, both=True)


def mapping(mapper, downstream) -> Collector:
    if not isinstance(downstream, Collector):
        raise PipelineBuildError("a collector is needed downstream")
    start, add, end = downstream.fold()
    return Native(lambda e, p: downstream.column(expr(mapper, e), p), start, lambda c, x: add(c, mapper(x)), end, downstream.value, downstream.needs_order)


def collecting_and_then(downstream, finisher) -> Collector:
    """finisher over the finished result: a Column function stays in the aggregate, anything else runs on the driver."""
    if not isinstance(downstream, Collector):
        raise PipelineBuildError("a collector is needed downstream")
    start, add, end = downstream.fold()

    def build(e, p):
        inner = downstream.column(e, p)
        try:
            got = finisher(inner)
        except Exception:
            got = None
        if not isinstance(got, Column):
            raise NotNative
        return got

    return Native(build, start, add, lambda c: finisher(end(c) if end else c), None, downstream.needs_order)


class _ToGenerator:
    """Marker: collect(to_generator) gives a lazy iterator over the pipeline."""


to_generator = _ToGenerator()
