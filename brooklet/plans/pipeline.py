"""The pipeline: immutable references to a source and its steps, lowered to one DataFrame plan at a terminal.

Encounter order is a key column that exists only where something asks for it: a walk from the terminal back to the
source finds out (`_demand`), since Catalyst can't prune the key of a file scan once it is referenced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark import cloudpickle
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PipelineBuildError, PipelineStateError, carried, terminal, unwrapped
from ..functions.comparators import Comparator, Ranked, natural
from ..functions.lanes import Element, called, is_async, resolve, results, truthy
from ..operators import collectors as C
from ..sources.sources import OWN, POS, FrameSource, LocalSource, iterated, normalised, session


SIDE, HASH, AT, LAST = (f"{OWN}{x}" for x in ("side", "hash", "at", "last"))
#: A skip of up to so many elements finds where to start by a top-k.
SKIP_BY_KEY = 100_000


@dataclass
class _Shared:
    """State that a pipeline and all its derivations have in common."""

    handlers: list = field(default_factory=list)
    drained: bool = False


@dataclass(frozen=True)
class _State:
    """A lowered prefix. order: columns (name, descending) of the encounter order, empty if there is none."""

    df: DataFrame
    kind: str  # record, column or pickle
    order: tuple[tuple[str, bool], ...]
    native: bool

    @property
    def names(self) -> list[str]:
        keys = {n for n, _ in self.order} | {POS}
        return [c for c in self.df.columns if c not in keys]

    @property
    def element(self):
        return F.col("v") if self.kind == "column" else Element(self.names)

    def sort(self) -> DataFrame:
        return self.df.orderBy(*(F.col(n).desc() if d else F.col(n).asc() for n, d in self.order)) if self.order else self.df

    def key(self) -> C.Order:
        """The order as one key; a reversed order is turned round where its columns are numbers."""
        if not self.order:
            zero = F.lit(0)
            return C.Order(zero, zero, self.df)
        kinds = {f.name: f.dataType for f in self.df.schema}
        up, down = [], []
        for n, d in self.order:
            number = isinstance(kinds[n], T.NumericType)
            if d and not number:
                raise C.NotNative
            up.append(-F.col(n) if d else F.col(n))
            down.append((F.col(n) if d else -F.col(n)) if number else None)
        flat = len(up) == 1
        return C.Order(up[0] if flat else F.struct(*up), None if any(x is None for x in down) else down[0] if flat else F.struct(*down), self.df)


def _decoded(batch: pa.RecordBatch, kind: str, names) -> list:
    if kind == "pickle":
        return [cloudpickle.loads(b) for b in batch.column("v").to_pylist()]
    if kind == "column":
        return batch.column("v").to_pylist()
    from pyspark.sql import Row

    make = Row(*names)
    return [make(*t) for t in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Builder:
    """Collects elements; build() takes a snapshot."""

    def __init__(self):
        self._items: list = []

    def add(self, item) -> Builder:
        self._items.append(item)
        return self

    def accept(self, item) -> None:
        self._items.append(item)

    def build(self) -> Pipeline:
        return Pipeline(list(self._items))


class Pipeline:
    """An ordered, lazy, single-use sequence of elements.

    Elements are rows of a table or Python values; see README for the lanes. Steps return a new reference and consume
    this one; terminals return Python values, or the one-plan DataFrame behind them with frame=True.
    """

    def __init__(self, source=(), close_handlers=None, order_by=None):
        if isinstance(source, DataFrame):
            source = FrameSource(source, order_by)
        elif not isinstance(source, (FrameSource, LocalSource, _Concat)):
            known = hasattr(source, "__len__") or not (hasattr(source, "__iter__") or hasattr(source, "__next__") or hasattr(source, "__aiter__") or hasattr(source, "__anext__"))
            source = LocalSource(normalised(source), lazy=not known)
        self._source, self._steps, self._shared = source, (), _Shared(list(close_handlers or ()))
        self._ordered, self._parallel, self._consumed = True, False, False

    # Factories

    @staticmethod
    def of(*args) -> Pipeline:
        """No argument: empty; one: a source; more: each is an element."""
        return Pipeline(args[0] if len(args) == 1 else list(args))

    @staticmethod
    def empty() -> Pipeline:
        return Pipeline([])

    @staticmethod
    def from_table(df: DataFrame, order_by=None) -> Pipeline:
        return Pipeline(df, order_by=order_by)

    @staticmethod
    def read(path: str, format: str = "parquet", order_by=None, **options) -> Pipeline:
        return Pipeline(session().read.format(format).options(**options).load(path), order_by=order_by)

    @staticmethod
    def iterate(seed, step) -> Pipeline:
        """seed, step(seed), ...: endless, pulled only as far as a limit, a find, a match or an iterator asks."""
        return Pipeline(LocalSource(iterated(seed, step), bounded=False))

    @staticmethod
    def builder() -> Builder:
        return Builder()

    @staticmethod
    def concat(a: Pipeline, b: Pipeline) -> Pipeline:
        """All of a, then all of b: a fresh pipeline; flags and close handlers of the inputs aren't taken over."""
        return Pipeline(_Concat(a, b))

    # Life cycle

    def _check(self) -> None:
        if self._consumed:
            raise PipelineStateError("this pipeline reference has been used already")

    def _derive(self, *step, **flags) -> Pipeline:
        self._check()
        self._consumed = True
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__)
        out._steps = (*self._steps, step) if step else self._steps
        out._consumed = False
        out.__dict__.update(flags)
        return out

    def parallel(self) -> Pipeline:
        """Terminals that don't promise an order may return elements in any order."""
        return self._derive(_parallel=True)

    def sequential(self) -> Pipeline:
        return self._derive(_parallel=False)

    def is_parallel(self) -> bool:
        return self._parallel

    def unordered(self) -> Pipeline:
        self._ordered = False
        return self

    def is_ordered(self) -> bool:
        return self._ordered

    def on_close(self, handler) -> Pipeline:
        self._shared.handlers.append(handler)
        return self

    def close(self) -> None:
        """Runs all handlers of the pipeline and its derivations in order; the first error is raised at the end."""
        first = None
        for handler in self._shared.handlers:
            try:
                handler()
            except Exception as e:
                first = first or e
        if first:
            raise first

    # Steps

    def filter(self, predicate) -> Pipeline:
        return self._derive("filter", predicate)

    def map(self, mapper) -> Pipeline:
        return self._derive("map", mapper)

    def flat_map(self, mapper) -> Pipeline:
        """mapper gives an array Column, or synchronously an iterable or a pipeline of Python values."""
        if is_async(getattr(mapper, "fn", mapper)):
            raise PipelineBuildError("flat_map needs a synchronous mapper")
        return self._derive("flat_map", mapper)

    def peek(self, consumer) -> Pipeline:
        """consumer runs on the executors for each element that flows; a task that runs again repeats its calls."""
        return self._derive("peek", consumer)

    def distinct(self) -> Pipeline:
        return self._derive("distinct")

    def sorted(self, comparator=None, reverse: bool = False) -> Pipeline:
        """Stable; reverse turns the ascending result round, ties included."""
        return self._derive("sorted", natural if comparator is None else comparator, reverse)

    def limit(self, n: int) -> Pipeline:
        return self._derive("limit", max(0, n))

    def skip(self, n: int) -> Pipeline:
        return self._derive("skip", max(0, n))

    # Lowering

    def _bound(self, more: int | None = None) -> int | None:
        """Elements that a Python source has to give: known where only one-to-one steps precede the first limits."""
        bound, skipped = more, 0
        limits = []
        for name, *args in self._steps:
            if name == "skip":
                skipped += args[0]
            elif name == "limit":
                limits.append(skipped + args[0])
            elif name not in ("map", "peek"):
                break
        else:
            if bound is not None:
                limits.append(skipped + bound)
        return min(limits, default=None)

    @property
    def _sorts(self) -> bool:
        """Whether a step sorts: its order holds in any mode; unordered() and parallel() free the source's order only."""
        return any(name == "sorted" for name, *_ in self._steps)

    def _demand(self, last: bool) -> bool:
        """Whether the source has to give its order: the terminal asks for it, or a step does whose order isn't replaced."""
        return last or (self._ordered and any(name in ("limit", "skip") for name, *_ in self._steps))

    def _pulled(self, stop: bool) -> bool:
        """Whether the source is to be read in chunks: it is lazy, and a limit or (stop) the terminal may end it early."""
        lazy = isinstance(self._source, LocalSource) and self._source.lazy and not self._shared.drained
        before = [name for name, *_ in self._steps]
        before = before[: before.index("sorted")] if "sorted" in before else before
        return lazy and ("limit" in before or (stop and not self._sorts)) and self._bound(None) is None

    def _chunks(self):
        """Lists of this pipeline's elements, pulled no further than limits ask: steps that look at one element run as Spark
        jobs over growing chunks, limit, skip and distinct count on the driver (what they keep is bounded by the limit)."""
        self._check()
        self._shared.drained = True
        parts: list[list] = [[]]
        for step in self._steps:
            if step[0] in ("limit", "skip", "distinct"):
                parts += [[step[0], step[1] if len(step) > 1 else set()], []]
            else:
                parts[-1].append(step)
        if any(p and p[0] == "limit" and p[1] == 0 for p in parts):
            return
        with unwrapped():
            for chunk in self._source.chunks():
                ended = False
                for part in parts:
                    if part and part[0] == "limit":
                        chunk, part[1] = chunk[: part[1]], part[1] - min(part[1], len(chunk))
                        ended = ended or not part[1]
                    elif part and part[0] == "skip":
                        chunk, part[1] = chunk[part[1] :], part[1] - min(part[1], len(chunk))
                    elif part and part[0] == "distinct":
                        fresh = []
                        for x in chunk:
                            if x not in part[1]:
                                part[1].add(x)
                                fresh.append(x)
                        chunk = fresh
                    elif part and chunk:
                        one = Pipeline(LocalSource(chunk))
                        one._steps = tuple(part)
                        chunk = list(one._items(True))
                if chunk:
                    yield chunk
                if ended:
                    return

    def _taken(self) -> Pipeline:
        """This pipeline with its source read in chunks up to its limits, and the steps from the first sort on still to do."""
        names = [name for name, *_ in self._steps]
        cut = names.index("sorted") if "sorted" in names else len(names)
        head = Pipeline(self._source)
        head._steps, head._shared = self._steps[:cut], self._shared
        out = Pipeline(LocalSource([x for chunk in head._chunks() for x in chunk]))
        out._steps, out._ordered, out._parallel = self._steps[cut:], self._ordered, self._parallel
        return out

    def _lower(self, need_order: bool, more: int | None = None) -> _State:
        self._check()
        if self._pulled(False):
            return self._taken()._lower(need_order, more)
        if self._shared.drained and not isinstance(self._source, FrameSource):
            state = _State(session().createDataFrame([], f"{POS} long, v string"), "column", ((POS, False),), False)
        else:
            need = self._demand(need_order)
            bound = self._bound(more)
            if isinstance(self._source, _Concat):
                state = self._source.state(need)
            else:
                df, kind = self._source.frame(need, bound)
                state = _State(df, kind, ((POS, False),) if POS in df.columns else (), self._source.native)
        self._shared.drained = True
        if self._bound() == 0:
            state = _State(state.df.limit(0), state.kind, state.order, state.native)
        for name, *args in self._steps:
            state = getattr(self, f"_on_{name}")(state, *args)
        return state

    def _python(self, state: _State, each, out_kind: str, schema: list[tuple[str, T.DataType | str]]) -> DataFrame:
        """mapInArrow of each(list of elements) -> (index of the source row, extra order, value) columns; keeps the order columns."""
        keys = [n for n, _ in state.order]
        kind, names = state.kind, state.names
        fields = [state.df.schema[k] for k in keys]
        full = T.StructType([*fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in schema)).fields])
        arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in full])

        def run(batches):
            for batch in batches:
                rows, columns = each(_decoded(batch, kind, names))
                kept = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
                own = [pa.array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(columns)]
                kept = [k if pa.types.is_nested(k.type) else k.cast(arrow.field(i).type) for i, k in enumerate(kept)]
                yield pa.RecordBatch.from_arrays(kept + own, names=arrow.names)

        return state.df.select(*keys, *names).mapInArrow(run, full)

    def _on_filter(self, state, predicate):
        lane = resolve(predicate, state.element, state.native)
        if lane[0] == "column":
            kind = state.df.select(lane[1].alias("c")).schema["c"].dataType
            # A boolean goes to the scan as it is: where() drops nulls, and a coalesce would keep it from being pushed down.
            test = lane[1] if isinstance(kind, T.BooleanType) else truthy(lane[1], kind)
            return _State(state.df.where(test), state.kind, state.order, state.native)
        _, fn, _, n = lane
        kind, names = state.kind, state.names

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([bool(x) for x in called(fn, _decoded(batch, kind, names), n)], pa.bool_()))

        return _State(state.df.mapInArrow(run, state.df.schema), state.kind, state.order, state.native)

    def _on_map(self, state, mapper):
        lane = resolve(mapper, state.element, state.native)
        keys = [F.col(n) for n, _ in state.order]
        if lane[0] == "column":
            out = state.df.select(*keys, lane[1].alias("v"))
            if isinstance(out.schema["v"].dataType, T.StructType) and out.schema["v"].dataType.fields:
                return _State(out.select(*keys, "v.*"), "record", state.order, True)
            return _State(out, "column", state.order, True)
        _, fn, returns, n = lane

        def each(items):
            got = called(fn, items, n)
            return range(len(items)), [got if returns else [cloudpickle.dumps(x) for x in got]]

        df = self._python(state, each, "", [("v", returns or "binary")])
        return _State(df, "column" if returns else "pickle", state.order, state.native and bool(returns))

    def _on_flat_map(self, state, mapper):
        lane = resolve(mapper, state.element, state.native)
        inner = f"{OWN}i{len(state.order)}"
        order = (*state.order, (inner, False)) if state.order else ()
        keys = [F.col(n) for n, _ in state.order]
        if lane[0] == "column":
            if order:
                out = state.df.select(*keys, F.posexplode(lane[1]).alias(inner, "v"))
            else:
                out = state.df.select(F.explode(lane[1]).alias("v"))
            if isinstance(out.schema["v"].dataType, T.StructType):
                out = out.select(*keys, *([inner] if order else []), "v.*")
                return _State(out, "record", order, True)
            return _State(out, "column", order, True)
        _, fn, returns, _ = lane

        def each(items):
            rows, at, values = [], [], []
            for i, x in enumerate(items):
                with carried():
                    inner_items = list(_inner(fn(x)))
                for k, v in enumerate(inner_items):
                    rows.append(i)
                    at.append(k)
                    values.append(v if returns else cloudpickle.dumps(v))
            return rows, [at, values]

        df = self._python(state, each, "", [(inner, "long"), ("v", returns or "binary")])
        return _State(df if order else df.drop(inner), "column" if returns else "pickle", order, state.native and bool(returns))

    def _on_peek(self, state, consumer):
        fn, n = getattr(consumer, "fn", consumer), 0
        kind, names = state.kind, state.names

        def run(batches):
            for batch in batches:
                called(fn, _decoded(batch, kind, names), n)
                yield batch

        return _State(state.df.mapInArrow(run, state.df.schema), state.kind, state.order, state.native)

    def _on_distinct(self, state):
        names = state.names
        if state.kind == "pickle":
            return self._distinct_objects(state)
        if any(isinstance(state.df.schema[n].dataType, (T.MapType, T.VariantType)) for n in names):
            raise TypeError("elements with maps can't be compared")
        if not state.order:
            return _State(state.df.select(*names).distinct(), state.kind, (), state.native)
        try:
            out = state.df.groupBy(*names).agg(F.min(state.key().up).alias(POS))
            return _State(out, state.kind, ((POS, False),), state.native)
        except C.NotNative:
            w = Window.partitionBy(*names).orderBy(*(F.col(n).desc() if d else F.col(n).asc() for n, d in state.order))
            out = state.df.withColumn(f"{OWN}rank", F.row_number().over(w)).where(F.col(f"{OWN}rank") == 1).drop(f"{OWN}rank")
            return _State(out, state.kind, state.order, state.native)

    def _on_sorted(self, state, comparator, reverse):
        before = tuple((n, d != reverse) for n, d in state.order)
        if isinstance(comparator, Comparator) and state.kind != "pickle":
            keys, order, df = [], [], state.df
            for i, (selector, desc) in enumerate(comparator.keys):
                got = F.struct(*state.names) if state.kind == "record" and comparator is natural else self._key(selector, state)
                if got is None:
                    break
                name = f"{OWN}k{len(state.order)}_{i}"
                keys.append((name, got))
                order.append((name, desc != reverse))
            else:
                for name, c in keys:
                    df = df.withColumn(name, c)
                return _State(df, state.kind, (*order, *before), state.native)
        compare = functools.partial(C._compare, comparator) if isinstance(comparator, Comparator) else comparator
        kind, names = state.kind, state.names
        width = len(names)

        def ranked(pair):
            row, at = pair
            item = cloudpickle.loads(row["v"]) if kind == "pickle" else row["v"] if kind == "column" else row
            return Ranked(compare, item, at)

        rows = state.sort().select(*names).rdd.zipWithIndex().sortBy(ranked)
        last = rows.zipWithIndex().map(lambda x: (*(x[0][0][i] for i in range(width)), -x[1] if reverse else x[1]))
        schema = T.StructType([*(state.df.schema[n] for n in names), T.StructField(POS, T.LongType())])
        return _State(session().createDataFrame(last, schema), kind, ((POS, False),), state.native)

    def _key(self, selector, state):
        if isinstance(selector, str):
            return F.col(selector)
        lane = resolve(selector, state.element, native=True)
        return lane[1] if lane[0] == "column" else None

    def _on_limit(self, state, n):
        return _State((state.sort() if self._ordered or self._sorts else state.df).limit(n), state.kind, state.order, state.native)

    def _on_skip(self, state, n):
        """Above the key of the n-th element, which a top-k finds, so that no task has to see all rows. Where the order has
        no unique key of one direction, or the top-k were large, an offset into the sorted rows."""
        if not n:
            return state
        unique = any(n == POS for n, _ in state.order)
        if unique and n <= SKIP_BY_KEY:
            try:
                key = state.key().up
                top = state.df.select(key.alias(AT)).orderBy(AT).limit(n)
                last = top.agg(F.max(AT).alias(LAST), F.count(F.lit(1)).alias(f"{OWN}n")).where(F.col(f"{OWN}n") == n).select(LAST)
                kept = state.df.join(F.broadcast(last), key > F.col(LAST)).drop(LAST)
                return _State(kept, state.kind, state.order, state.native)
            except C.NotNative:
                pass
        return _State((state.sort() if self._ordered or self._sorts else state.df).offset(n), state.kind, state.order, state.native)

    def _distinct_objects(self, state) -> _State:
        """Python's own equality: elements meet by their hash; each batch gives the first of equal ones only, so a common
        element makes a group of one row a batch. Workers share a hash seed, as Spark sets it."""
        kind, names, keys = state.kind, state.names, [n for n, _ in state.order]

        def hashed(batches):
            for batch in batches:
                with carried():
                    seen: dict = {}
                    for i, x in enumerate(_decoded(batch, kind, names)):
                        seen.setdefault(x, i)  # rows of a batch are in encounter order
                    found = [hash(x) for x in seen]
                kept = batch.take(pa.array(list(seen.values()), pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int64())], names=[*kept.schema.names, HASH])

        schema = T.StructType([*state.df.schema.fields, T.StructField(HASH, T.LongType())])
        rows = state.df.sortWithinPartitions(*(F.col(n).desc() if d else F.col(n).asc() for n, d in state.order)) if state.order else state.df
        order = [(n, "descending" if d else "ascending") for n, d in state.order]
        if any(isinstance(state.df.schema[k].dataType, T.StructType) for k in keys):  # Arrow doesn't sort by structs
            at = F.row_number().over(Window.partitionBy(HASH).orderBy(*(F.col(n).desc() if d else F.col(n).asc() for n, d in state.order)))
            rows, order, extra = rows.mapInArrow(hashed, schema).withColumn(AT, at), [(AT, "ascending")], [AT]
        else:
            rows, extra = rows.mapInArrow(hashed, schema), []

        def first(t: pa.Table) -> pa.Table:
            t = (t.sort_by(order) if order else t).drop_columns([HASH, *extra])
            seen: dict = {}
            for i, x in enumerate(cloudpickle.loads(v) for v in t.column("v").to_pylist()):
                seen.setdefault(x, i)
            return t.take(pa.array(list(seen.values()), pa.int64()))

        return _State(rows.groupBy(HASH).applyInArrow(first, state.df.schema), kind, state.order, state.native)

    # Pulling out

    def frame(self) -> DataFrame:
        """The elements as a DataFrame in encounter order (any order if unordered), without the order key."""
        state = self._lower(self._ordered)
        return state.sort().select(*state.names)

    def _items(self, need_order: bool, more: int | None = None):
        if self._pulled(True) and (more is None or self._bound(more) is None):
            for chunk in self._chunks():
                yield from chunk
            return
        with unwrapped():
            state = self._lower(need_order, more)
            names, kind = state.names, state.kind
            rows = (state.sort() if need_order or self._sorts else state.df).select(*names)
            for row in (rows if more is None else rows.limit(more)).toLocalIterator(prefetchPartitions=False):
                yield cloudpickle.loads(row["v"]) if kind == "pickle" else row["v"] if kind == "column" else row

    def iterator(self):
        """Elements on the driver, pulled as they are asked for; in encounter order unless parallel, and sorted if a step sorts."""
        self._check()
        return self._items(self._ordered and not self._parallel)

    def for_each(self, consumer) -> None:
        """consumer(element) on the driver, in encounter order unless parallel; async consumers are awaited one by one."""
        for x in self.iterator():
            results(consumer, [x], 0)

    def for_each_ordered(self, consumer) -> None:
        for x in self._items(True):
            results(consumer, [x], 0)

    def for_each_partition(self, consumer) -> None:
        """consumer(iterator of elements) on the executors, once a partition and attempt."""
        state = self._lower(False)
        names, kind = state.names, state.kind

        def run(rows):
            with carried():
                consumer(cloudpickle.loads(r["v"]) if kind == "pickle" else r["v"] if kind == "column" else r for r in rows)

        with unwrapped():
            state.df.select(*names).foreachPartition(run)

    # Terminals

    @terminal
    def count(self, frame: bool = False):
        df = self._lower(False).df.agg(F.count(F.lit(1)).alias("n"))
        return df if frame else df.first()[0]

    @terminal
    def reduce(self, *args, frame: bool = False):
        """reduce(acc) or reduce(identity, acc): an ordered left fold; reduce(identity, acc, combiner) folds each partition
        and combines the parts where the pipeline is unordered, and is reduce(identity, acc) otherwise."""
        if len(args) == 3:
            if not self._ordered and not self._sorts:
                identity, acc, combiner = args
                return self._partial(lambda: identity, acc, combiner)
            args = args[:2]
        if not 1 <= len(args) <= 2:
            raise TypeError("reduce takes an accumulator, an identity and an accumulator, or these and a combiner")
        return self.collect(C.reducing(*args), frame=frame)

    def _partial(self, start, acc, combiner):
        """start() folded over each partition by acc(total, element) on the executors, the parts by combiner on the driver."""
        state = self._lower(False)
        kind, names = state.kind, state.names

        def run(batches):
            total = start()
            for batch in batches:
                with carried():
                    for x in _decoded(batch, kind, names):
                        total = acc(total, x)
            yield pa.RecordBatch.from_pydict({"v": pa.array([cloudpickle.dumps(total)], pa.binary())})

        parts = state.df.select(*names).mapInArrow(run, "v binary").toLocalIterator()
        return functools.reduce(combiner, (cloudpickle.loads(r.v) for r in parts), start())

    @terminal
    def min(self, comparator=None, frame: bool = False):
        return self.collect(C.min_by(comparator), frame=frame)

    @terminal
    def max(self, comparator=None, frame: bool = False):
        return self.collect(C.max_by(comparator), frame=frame)

    @terminal
    def to_array(self) -> list:
        return self.collect(C.to_list())

    @terminal
    def find_first(self, frame: bool = False):
        return self._found(self._ordered, frame)

    @terminal
    def find_any(self, frame: bool = False):
        return self._found(False, frame)

    def _found(self, need_order: bool, frame: bool):
        if frame:
            state = self._lower(need_order, 1)
            return (state.sort() if need_order or self._sorts else state.df).select(*state.names).limit(1)
        items = self._items(need_order, 1)
        try:
            return next(items, None)
        finally:
            items.close()

    def _match(self, predicate, negate: bool, frame: bool, build):
        if not frame and self._pulled(True):
            hits = self._derive("map", predicate)._chunks()
            try:
                return any(bool(x) != negate for chunk in hits for x in chunk)
            finally:
                hits.close()
        state = self._lower(False)
        lane = resolve(predicate, state.element, state.native)
        if lane[0] == "column":
            kind = state.df.select(lane[1].alias("c")).schema["c"].dataType
            hit = truthy(lane[1], kind)
            if frame:
                return state.df.agg(build(hit).alias("r"))
            return not state.df.where(~hit if negate else hit).isEmpty()
        _, fn, _, n = lane
        names, kind = state.names, state.kind

        def run(batches):
            for batch in batches:
                hits = [x for x in called(fn, _decoded(batch, kind, names), n) if bool(x) != negate]
                if hits:
                    yield pa.RecordBatch.from_pydict({"r": pa.array([True])})
                    return

        found = state.df.select(*names).mapInArrow(run, "r boolean")
        if frame:
            hit = F.count(F.lit(1)) > 0
            return found.agg((~hit if negate else hit).alias("r"))
        return not found.isEmpty()

    @terminal
    def any_match(self, predicate, frame: bool = False):
        """False on empty."""
        return self._match(predicate, False, frame, lambda hit: F.coalesce(F.bool_or(hit), F.lit(False)))

    @terminal
    def all_match(self, predicate, frame: bool = False):
        """True on empty."""
        got = self._match(predicate, True, frame, lambda hit: F.coalesce(F.bool_and(hit), F.lit(True)))
        return got if frame else not got

    @terminal
    def none_match(self, predicate, frame: bool = False):
        """True on empty."""
        if frame:
            return self.any_match(predicate, frame=True).select((~F.col("r")).alias("r"))
        return not self._match(predicate, False, False, None)

    @terminal
    def collect(self, collector, accumulator=None, combiner=None, frame: bool = False):
        """collect(Collector), collect(to_generator), or collect(supplier, accumulator, combiner).

        Column collectors compile to one aggregation; the others fold on the driver, in encounter order, over rows that
        stream in partition by partition. An unordered pipeline with a combiner folds each partition on its executor. With frame=True: a one-row DataFrame (`r`), or a row (`k`..., `r`) for each key.
        """
        if isinstance(collector, C._ToGenerator):
            return self.iterator()
        if accumulator is not None:
            collector = C.Collector(collector, accumulator, combiner)
        if not isinstance(collector, C.Collector):
            raise PipelineBuildError("collect needs a Collector, to_generator, or a supplier with an accumulator")
        self._check()
        if isinstance(self._source, FrameSource) or frame:
            try:
                return self._native(collector, frame)
            except C.NotNative:
                self._shared.drained = False
                if frame:
                    raise PipelineBuildError("this collector has opaque parts; it gives no frame") from None
        supplier, add, finisher = collector.fold()
        if type(collector) is C.Collector and collector.combiner and not self._ordered and not self._sorts:
            return _settle(finisher(got)) if (got := self._partial(supplier, _added(add), _merged(collector.combiner))) is not None and finisher else got
        container = _settle(supplier())
        for x in self._items(self._ordered):
            _settle(add(container, x))
        return _settle(finisher(container)) if finisher else container

    def _native(self, collector, frame: bool):
        state = self._lower(_wants_order(collector) or not frame and isinstance(collector, (C.Grouping, C.ToMap)))
        if state.kind == "pickle":
            raise C.NotNative
        pos, element = state.key(), state.element
        if not isinstance(collector, (C.Grouping, C.ToMap)):
            df = state.df.agg(collector.column(element, pos).alias("r"))
            return df if frame else collector.value(df.first()[0])
        keys, inner = [], collector
        while isinstance(inner, (C.Grouping, C.ToMap)):
            if isinstance(inner, C.ToMap):
                own, inner = inner.group(element)
                keys += [(k, False) for k in own]
            else:
                k = C.expr(inner.classifier, element)
                if inner.both:
                    k = truthy(k, state.df.select(k.alias("c")).schema["c"].dataType)
                keys.append((k, inner.both))
                inner = inner.downstream
        names = ["k"] if len(keys) == 1 else [f"k{i + 1}" for i in range(len(keys))]
        value = inner.column(element, pos)
        grouped = state.df.groupBy(*(k.alias(n) for (k, _), n in zip(keys, names, strict=True)))
        if frame:
            out = grouped.agg(value.alias("r"))
            if keys[-1][1]:  # both keys are there, with the downstream's value for no element
                both = session().createDataFrame([(True,), (False,)], f"{names[-1]} boolean")
                if len(names) > 1:
                    both = out.select(*names[:-1]).distinct().join(F.broadcast(both))
                empty = state.df.limit(0).agg(value.alias("_empty"))
                out = both.join(out, names, "left").join(F.broadcast(empty)).select(*names, F.coalesce("r", "_empty").alias("r"))
            return out
        out = grouped.agg(value.alias("r"), F.min(pos.up).alias(POS)).orderBy(POS)
        result: dict = {}
        empty = None
        for row in out.collect():
            at = result
            for i, n in enumerate(names[:-1]):
                at = at.setdefault(row[n], {})
            at[row[names[-1]]] = inner.value(row["r"])
        if any(b for _, b in keys):
            empty = inner.value(state.df.limit(0).agg(value.alias("r")).first()[0])
        return _filled(result, [b for _, b in keys], empty)


def _added(add):
    def run(container, x):
        _settle(add(container, x))
        return container

    return run


def _merged(combiner):
    """combiner(a, b) may give the result or put b into a."""

    def run(a, b):
        got = _settle(combiner(a, b))
        return a if got is None else got

    return run


def _filled(result: dict, both: list[bool], empty):
    """Partitions get both keys, in the order True, False."""
    if not both:
        return result
    if both[0]:
        rest = {} if len(both) > 1 else empty
        result = {True: result.get(True, rest), False: result.get(False, rest)}
    return {k: _filled(v, both[1:], empty) for k, v in result.items()} if len(both) > 1 else result


def _wants_order(collector) -> bool:
    if isinstance(collector, C.Grouping):
        return _wants_order(collector.downstream)
    if isinstance(collector, C.ToMap):
        return collector.merge is not None
    return collector.needs_order


def _settle(x):
    import asyncio
    import inspect

    return asyncio.run(C._settled(x)) if inspect.isawaitable(x) else x


def _inner(got):
    """Elements of what flat_map's mapper gave."""
    if isinstance(got, Pipeline):
        if got._steps or not isinstance(got._source, LocalSource):
            raise PipelineBuildError("an inner pipeline must hold plain Python values")
        return got._source.pull(None)
    return normalised(got)


class _Concat:
    """Two pipelines one after the other; b is lowered after a."""

    native = False

    def __init__(self, a: Pipeline, b: Pipeline):
        a._check()
        b._check()
        self.a, self.b = a, b
        self.native = a._source.native and b._source.native

    def state(self, need: bool) -> _State:
        sides = [p._lower(need and (p._ordered or p._sorts)) for p in (self.a, self.b)]
        if {s.kind for s in sides} != {sides[0].kind} or (sides[0].kind == "column" and len({s.df.schema["v"].dataType for s in sides}) > 1):
            sides = [_pickled(s) for s in sides]
        out = []
        for i, s in enumerate(sides):
            df = s.df.select(*s.names)
            if need:
                key = s.key().up
                df = s.df.select(*s.names, F.lit(i).alias(SIDE), key.alias(POS))
            out.append(df)
        if need and out[0].schema[POS].dataType != out[1].schema[POS].dataType:
            out = [d.withColumn(f"{OWN}p{i}", F.col(POS)).drop(POS) for i, d in enumerate(out)]
            both = out[0].unionByName(out[1], allowMissingColumns=True)
            return _State(both, sides[0].kind, ((SIDE, False), (f"{OWN}p0", False), (f"{OWN}p1", False)), self.native)
        both = out[0].unionByName(out[1])
        return _State(both, sides[0].kind, ((SIDE, False), (POS, False)) if need else (), self.native)


def _pickled(s: _State) -> _State:
    if s.kind == "pickle":
        return s
    keys, kind, names = [n for n, _ in s.order], s.kind, s.names
    schema = T.StructType([*(s.df.schema[k] for k in keys), T.StructField("v", T.BinaryType())])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches):
        for batch in batches:
            own = pa.array([cloudpickle.dumps(x) for x in _decoded(batch, kind, names)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), own], names=arrow.names)

    return _State(s.df.select(*keys, *names).mapInArrow(run, schema), "pickle", s.order, False)
