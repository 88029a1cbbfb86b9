"""Operators and collectors over small values: order, ties, None, empties, single use, laziness, lanes."""

import asyncio

import pytest

from brooklet import Pipeline, PipelineBuildError, PipelineStateError, aio, by, py
from brooklet import operators as C

pytestmark = pytest.mark.usefixtures("spark")


def test_sources():
    assert Pipeline.of().to_array() == []
    assert Pipeline.of([1, 2, 3]).to_array() == [1, 2, 3]
    assert Pipeline.of([1], [2]).to_array() == [[1], [2]]
    assert Pipeline.of("abc").to_array() == ["abc"]
    assert Pipeline.of(None).count() == 1
    assert Pipeline.of({"a": 1}).to_array() == [{"a": 1}]
    assert Pipeline.of(1, "a", None, 2.5).to_array() == [1, "a", None, 2.5]
    assert Pipeline.builder().add(1).add(2).build().to_array() == [1, 2]

    async def feed():
        for i in range(3):
            yield i

    assert Pipeline.of(feed()).to_array() == [0, 1, 2]


def test_iterate_pulls_no_more_than_asked():
    pulled = []

    def step(x):
        pulled.append(x)
        return x + 1

    assert Pipeline.iterate(0, step).map(lambda x: x * 2).skip(1).limit(3).to_array() == [2, 4, 6]
    assert pulled == [0, 1, 2]
    with pytest.raises(PipelineBuildError):
        Pipeline.iterate(0, step).count()


def test_steps():
    assert Pipeline.of([4, 1, 3]).filter(lambda x: x > 1).map(lambda x: x * 2).to_array() == [8, 6]
    assert Pipeline.of([[1, 2], [3]]).flat_map(lambda x: x).to_array() == [1, 2, 3]
    assert Pipeline.of([1, 2]).flat_map(lambda x: Pipeline.of([x, x])).to_array() == [1, 1, 2, 2]
    assert Pipeline.of([3, 1, 3, 2, 1]).distinct().to_array() == [3, 1, 2]
    assert Pipeline.of([1, 2, 3]).limit(-1).to_array() == []
    assert Pipeline.of([1, 2, 3]).skip(5).to_array() == []
    assert Pipeline.of([1, 2, 3]).peek(lambda x: None).to_array() == [1, 2, 3]
    assert Pipeline.concat(Pipeline.of([2, 1]), Pipeline.of(["a"])).to_array() == [2, 1, "a"]


def test_sorts():
    words = ["bb", "a", "cc", "d"]
    assert Pipeline.of([3, 1, 2]).sorted().to_array() == [1, 2, 3]
    assert Pipeline.of(words).sorted(by(lambda w: len(w))).to_array() == ["a", "d", "bb", "cc"]
    assert Pipeline.of(words).sorted(by(lambda w: len(w)), reverse=True).to_array() == ["cc", "bb", "d", "a"]
    assert Pipeline.of(words).sorted(lambda a, b: len(a) - len(b)).limit(2).to_array() == ["a", "d"]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_result_does_not_depend_on_partitions(spark, parts):
    df = spark.range(60).selectExpr("id", "id % 7 AS k").repartition(parts)
    assert Pipeline.from_table(df, "id").sorted(by(lambda e: e.k)).limit(10).map(lambda e: e.id).to_array() == [0, 7, 14, 21, 28, 35, 42, 49, 56, 1]
    assert Pipeline.from_table(df, "id").max(by(lambda e: e.k)).id == 6
    assert Pipeline.from_table(df, "id").map(py(lambda e: e.id + 1, "long")).skip(58).to_array() == [59, 60]
    assert Pipeline.from_table(df, "id").map(lambda e: e.k).distinct().to_array() == list(range(7))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_sorts_hold_in_any_mode(spark, parts):
    df = spark.range(60).selectExpr("id", "(id * 17) % 60 AS k").repartition(parts)
    t = lambda: Pipeline.from_table(df, "id")
    key = by(lambda e: e.k)
    for p in (lambda: t().unordered(), lambda: t().parallel(), lambda: t().parallel().unordered()):
        assert [e.k for e in p().sorted(key).iterator()] == list(range(60))
        assert p().sorted(key).limit(5).map(lambda e: e.k).to_array() == [0, 1, 2, 3, 4]
        assert p().sorted(key).skip(57).map(lambda e: e.k).to_array() == [57, 58, 59]
        assert p().sorted(key).find_first().k == 0
        seen = []
        p().sorted(key).for_each(lambda e: seen.append(e.k))  # noqa: B023
        assert seen == list(range(60))
    assert [e.k for e in Pipeline.from_table(df, "id").sorted(key).unordered().frame().collect()] == list(range(60))
    assert Pipeline.of([3, 1, 2]).unordered().sorted().to_array() == [1, 2, 3]
    assert list(Pipeline.of([3, 1, 2]).parallel().sorted().iterator()) == [1, 2, 3]
    assert list(Pipeline.of([3, 1, 2]).parallel().sorted(lambda a, b: b - a).iterator()) == [3, 2, 1]
    for n in (0, 1, 59, 60, 99):
        assert t().skip(n).map(lambda e: e.id).to_array() == list(range(60))[n:]
    gone = Pipeline.from_table(df, "id").map(py(lambda e: (e.k % 7, "x"))).distinct().to_array()
    assert gone == list(dict.fromkeys(((i * 17) % 60 % 7, "x") for i in range(60)))


def _counted(items, log):
    for x in items:
        log.append(x)
        yield x


def test_endless_sources_are_pulled_as_far_as_needed():
    import itertools

    pulled = []
    assert Pipeline.of(_counted(itertools.count(), pulled)).filter(lambda x: x % 5 == 4).limit(3).to_array() == [4, 9, 14]
    assert len(pulled) <= 16
    assert Pipeline.iterate(1, lambda x: x + 1).filter(lambda x: x % 100 == 0).find_first() == 100
    assert Pipeline.iterate(1, lambda x: x + 1).any_match(lambda x: x > 40) and not Pipeline.iterate(1, lambda x: x + 1).all_match(lambda x: x < 40)
    assert not Pipeline.iterate(1, lambda x: x + 1).none_match(lambda x: x == 40)
    it = Pipeline.iterate((0, 1), lambda s: (s[1], s[0] + s[1])).map(lambda s: s[0]).collect(C.to_generator)
    assert [next(it) for _ in range(10)] == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34]
    it.close()
    assert Pipeline.of(itertools.count()).map(lambda x: x % 4).distinct().skip(1).limit(3).to_array() == [1, 2, 3]
    assert Pipeline.of(itertools.count()).flat_map(lambda x: [x] * x).limit(4).sorted(reverse=True).limit(2).to_array() == [3, 2]
    assert Pipeline.of(itertools.count()).filter(lambda x: True).limit(0).to_array() == []
    assert Pipeline.of(itertools.count()).filter(lambda x: x > 3).limit(7).count() == 7

    def failing():
        yield from range(20)
        raise ValueError("boom")

    assert Pipeline.of(failing()).filter(lambda x: x > 2).limit(3).to_array() == [3, 4, 5]
    with pytest.raises(ValueError, match="boom"):
        Pipeline.of(failing()).filter(lambda x: x > 2).limit(30).to_array()
    closed = []

    def closing():
        try:
            yield from itertools.count()
        finally:
            closed.append(True)

    assert Pipeline.of(closing()).filter(lambda x: x > 2).find_first() == 3 and closed == [True]
    with pytest.raises(PipelineBuildError):
        Pipeline.iterate(0, lambda x: x + 1).filter(lambda x: True).sorted().limit(3).to_array()


def test_exceptions_reach_the_caller_as_they_are(spark):
    class Own(Exception):
        pass

    def bad(x):
        if x == 3:
            raise Own("boom", x)
        return x

    async def slow(x):
        raise KeyError(x)

    for run in (
        lambda p: p.map(bad).to_array(), lambda p: p.filter(bad).count(), lambda p: p.flat_map(bad).to_array(), lambda p: p.peek(bad).count(),
        lambda p: p.any_match(lambda x: bad(x) > 9), lambda p: list(p.map(bad).iterator()), lambda p: p.for_each(bad), lambda p: p.unordered().reduce(0, lambda a, x: a + bad(x), lambda a, b: a + b),
    ):
        with pytest.raises(Own) as e:
            run(Pipeline.of([1, 2, 3, 4]))
        assert e.value.args == ("boom", 3)
    with pytest.raises(KeyError):
        Pipeline.of([1]).map(slow).to_array()
    with pytest.raises(TypeError):
        Pipeline.of([2, 1, 3]).sorted(lambda a, b: a < b).to_array()


def test_wide_sums_and_own_names(spark):
    big = spark.createDataFrame([(1 << 62, 1), (1 << 62, 2)], "v long, id long")
    assert Pipeline.from_table(big, "id").collect(C.summing_long(lambda e: e.v)) == 1 << 63
    assert Pipeline.from_table(big, "id").collect(C.summarizing_long(lambda e: e.v)).sum == 1 << 63
    odd = spark.createDataFrame([(1, 7), (2, 8)], "id long, _pos long")
    assert [r._pos for r in Pipeline.from_table(odd, "id").sorted(by(lambda e: -e.id)).iterator()] == [8, 7]
    with pytest.raises(PipelineBuildError):
        Pipeline.from_table(spark.range(1).withColumnRenamed("id", "__brooklet_pos"))
    got = Pipeline.from_table(spark.range(50), "id").unordered().map(lambda e: e.id).collect(list, lambda c, x: c.append(x), lambda a, b: a.extend(b))
    assert sorted(got) == list(range(50))


def test_terminals_on_empty_and_ties():
    e = Pipeline.empty
    assert (e().count(), e().min(), e().max(), e().find_first(), e().find_any()) == (0, None, None, None, None)
    assert (e().any_match(lambda x: True), e().all_match(lambda x: False), e().none_match(lambda x: True)) == (False, True, True)
    assert (e().reduce(lambda a, b: a + b), e().reduce(7, lambda a, b: a + b)) == (None, 7)
    pairs = [(1, "x"), (0, "y"), (1, "z"), (0, "w")]
    key = by(lambda p: p[0])
    assert (Pipeline.of(pairs).min(key), Pipeline.of(pairs).max(key)) == ((0, "y"), (1, "x"))
    with pytest.raises(TypeError):
        Pipeline.of([1, 2]).min(lambda a, b: a < b)


def test_collectors():
    words = ["a", "bb", "cc", "a"]
    of = lambda: Pipeline.of(words)
    assert of().collect(C.to_set()) == {"a", "bb", "cc"}
    assert of().collect(C.joining(",", "[", "]")) == "[a,bb,cc,a]"
    assert of().collect(C.counting()) == 4
    assert of().collect(C.summing_int(len)) == 6
    assert of().collect(C.averaging_int(len)) == 1.5
    assert of().collect(C.summarizing_int(len)) == (4, 6, 1, 2, 1.5)
    assert of().collect(C.grouping_by(len)) == {1: ["a", "a"], 2: ["bb", "cc"]}
    assert of().collect(C.grouping_by(len, C.mapping(str.upper, C.joining()))) == {1: "AA", 2: "BBCC"}
    assert of().collect(C.partitioning_by(lambda w: len(w) > 5, C.counting())) == {True: 0, False: 4}
    assert of().collect(C.reducing(0, len, lambda a, b: a * 10 + b)) == 1221
    assert of().collect(C.collecting_and_then(C.to_list(), len)) == 4
    assert of().collect(C.to_map(lambda w: w, len, lambda a, b: a + b)) == {"a": 2, "bb": 2, "cc": 2}
    with pytest.raises(ValueError, match="Duplicate key"):
        of().collect(C.to_map(lambda w: w, len))
    with pytest.raises(PipelineBuildError):
        C.grouping_by(len, 5)
    assert list(of().collect(C.to_generator)) == words
    empty = Pipeline.empty
    assert empty().collect(C.joining(",", "<", ">")) == "<>"
    assert empty().collect(C.summarizing_double(float)) == (0, 0.0, None, None, 0.0)
    assert empty().collect(C.grouping_by(len)) == {}


def test_table_collectors_match_python(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "a", 5.0), (4, None, 1.0)], "id long, g string, x double")
    p = lambda: Pipeline.from_table(df, "id")
    assert p().collect(C.grouping_by(lambda e: e.g, C.mapping(lambda e: e.id, C.to_list()))) == {"a": [1, 3], "b": [2], None: [4]}
    assert p().collect(C.partitioning_by(lambda e: e.x > 9, C.counting())) == {True: 0, False: 4}
    assert p().collect(C.summarizing_double(lambda e: e.x)).max == 5.0
    assert p().map(lambda e: e.x).to_array() == [2.0, None, 5.0, 1.0]
    assert p().all_match(lambda e: e.x > 0) is False


def test_single_use_and_life_cycle():
    p = Pipeline.of([1, 2])
    q = p.map(lambda x: x)
    for use in (p.count, lambda: p.map(lambda x: x), p.parallel, p.iterator):
        with pytest.raises(PipelineStateError):
            use()
    log = []
    q.on_close(lambda: log.append(1)).on_close(lambda: 1 / 0).on_close(lambda: log.append(2))
    with pytest.raises(ZeroDivisionError):
        p.close()
    assert log == [1, 2]
    once = Pipeline.of([1, 2])
    assert (once.count(), once.count()) == (2, 0)
    assert Pipeline.of([1]).parallel().is_parallel() and not Pipeline.of([1]).unordered().is_ordered()


def test_async_and_opaque_lanes():
    async def slow(x):
        await asyncio.sleep(0.01)
        return x + 1

    assert Pipeline.of([1, 2, 3]).map(slow).to_array() == [2, 3, 4]
    assert Pipeline.of([1, 2, 3]).map(aio(slow, "long", 8)).filter(lambda x: x != 3).to_array() == [2, 4]
    with pytest.raises(PipelineBuildError):
        Pipeline.of([1]).flat_map(slow)
    assert Pipeline.of([1, 2, 3]).collect(C.Collector(list, lambda c, x: c.insert(0, x))) == [3, 2, 1]
    seen = []
    Pipeline.of([3, 1, 2]).parallel().for_each_ordered(seen.append)
    assert seen == [3, 1, 2]


def test_plans(spark):
    """No sort or order key where nothing asks for one; a top-k is one operator."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = lambda d: d._jdf.queryExecution().executedPlan().toString()
    plan = text(Pipeline.from_table(df).filter(lambda e: e.l_quantity > 25).count(frame=True))
    assert "Sort" not in plan and "row_index" not in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert "TakeOrderedAndProject" in text(Pipeline.from_table(orders, "o_orderkey").sorted(by(lambda o: o.o_totalprice)).limit(5).frame())
    rows = text(Pipeline.from_table(orders, "o_orderkey").skip(9).map(py(lambda o: (o.o_custkey % 5,))).distinct().count(frame=True))
    assert "GlobalLimit" not in rows and "CollectLimit" not in rows and rows.count("SinglePartition") <= 2  # the total, and the one row of the skip
