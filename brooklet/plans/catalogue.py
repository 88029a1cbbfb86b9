"""One query per operator over the tables of a folder, each beside the SQL that says the same.

The inventory ids are those of the survey. Whole tables are read; limits occur only where the operator is a limit.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..errors import PipelineStateError
from ..functions import aio, by, py
from ..operators import (
    Collector,
    averaging_int,
    collecting_and_then,
    counting,
    grouping_by,
    joining,
    mapping,
    max_by,
    min_by,
    partitioning_by,
    reducing,
    summarizing_double,
    summarizing_int,
    summing_double,
    summing_int,
    to_collection,
    to_generator,
    to_list,
    to_map,
    to_set,
)
from .pipeline import Pipeline

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(fn):
        def run(spark, sf_dir, fn=fn):
            return fn(lambda table, order_by=None: Pipeline.from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), order_by))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def named(df, **names):
    """df with its columns renamed."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def money(c):
    """Decimal sums don't depend on the order of rows; doubles' do."""
    return c.cast("decimal(18,2)")


@query("SELECT event_id, value FROM events WHERE coalesce(value > 50 AND event_type = 'click', false)")
def filter_events(t):
    return t("events", "event_id").filter(lambda e: (e.value > 50) & (e.event_type == "click")).map(lambda e: {"event_id": e.event_id, "value": e.value}).frame()


@query("SELECT event_id, value FROM events WHERE coalesce(value > 50 AND event_type = 'click', false)")
def filter_python(t):
    """P1, Python lane."""
    return t("events", "event_id").filter(py(lambda e: e.value is not None and e.value > 50 and e.event_type == "click")).map(lambda e: {"event_id": e.event_id, "value": e.value}).frame()


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS doubled FROM orders")
def map_price(t):
    return t("orders", "o_orderkey").map(lambda o: {"o_orderkey": o.o_orderkey, "doubled": (money(o.o_totalprice) * 2).cast("double")}).unordered().frame()


@query("SELECT o_orderkey * 2 AS v FROM orders")
def map_python(t):
    return t("orders", "o_orderkey").map(py(lambda o: o.o_orderkey * 2, "long")).unordered().frame()


async def _twice(o):
    return o.o_orderkey * 2


@query("SELECT o_orderkey * 2 AS v FROM orders")
def map_async(t):
    """F5, async lane."""
    return t("orders", "o_orderkey").map(aio(_twice, "long", 64)).unordered().frame()


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def map_lookup(t):
    """J1: a map through a small lookup is a join; Catalyst broadcasts it if its size allows."""
    nation = t("nation").unordered().frame()
    s = t("supplier").unordered().frame()
    return s.join(nation, s.s_nationkey == nation.n_nationkey, "left").select("s_suppkey", F.col("n_name").alias("nation"))


@query("SELECT event_id FROM events")
def peek_passthrough(t):
    return t("events").unordered().peek(lambda e: None).map(lambda e: {"event_id": e.event_id}).frame()


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS word FROM (SELECT doc_id, string_split(text, ' ') AS s, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents)")
def flat_map_words(t):
    words = lambda d: F.transform(F.split(d.text, " "), lambda w, i: F.struct(d.doc_id.alias("doc_id"), i.alias("pos"), w.alias("word")))
    return t("documents").unordered().flat_map(words).frame()


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS e FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def flat_map_vector(t):
    parts = lambda v: F.transform(v.embedding, lambda x, i: F.struct(v.vec_id.alias("vec_id"), i.alias("pos"), x.cast("double").alias("e")))
    return t("embeddings").unordered().flat_map(parts).frame()


@query("SELECT count(1) AS n FROM events WHERE false")
def empty_count(t):
    return t("events").filter("false").count(frame=True)


@query("SELECT 0 AS side, CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation UNION ALL SELECT 1, CAST(r_regionkey AS BIGINT), r_name FROM region")
def concat_nation_region(t):
    a = t("nation", "n_nationkey").map(lambda n: {"side": F.lit(0), "k": n.n_nationkey.cast("long"), "name": n.n_name})
    b = t("region", "r_regionkey").map(lambda r: {"side": F.lit(1), "k": r.r_regionkey.cast("long"), "name": r.r_name})
    return Pipeline.concat(a, b).frame()


@query("SELECT event_type, min(event_id) AS pos FROM events GROUP BY event_type")
def distinct_first_seen(t):
    p = t("events", "event_id").map(lambda e: {"event_type": e.event_type}).distinct()
    state = p._lower(True)
    return state.df.select("event_type", F.col(state.order[0][0]).alias("pos"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_unordered(t):
    return t("events").unordered().map(lambda e: {"user_id": e.user_id, "event_type": e.event_type}).distinct().frame()


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_distinct(t):
    a, b = t("customer").map(lambda c: {"k": c.c_nationkey}), t("supplier").map(lambda s: {"k": s.s_nationkey})
    return Pipeline.concat(a.unordered(), b.unordered()).unordered().distinct().frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def sorted_topk(t):
    return t("orders", "o_orderkey").sorted(by(lambda o: o.o_totalprice)).limit(10).map(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).frame()


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 25")
def sorted_reverse_topk(t):
    return t("part", "p_partkey").sorted(by(lambda p: p.p_size), reverse=True).limit(25).map(lambda p: {"p_partkey": p.p_partkey, "p_size": p.p_size}).frame()


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 1000), c_custkey LIMIT 20")
def sorted_comparator_abs(t):
    return t("customer", "c_custkey").sorted(by(lambda c: F.abs(c.c_acctbal - 1000))).limit(20).map(lambda c: {"c_custkey": c.c_custkey, "c_acctbal": c.c_acctbal}).frame()


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def sorted_opaque(t):
    """O2: a three-way Python function."""
    order = lambda a, b: (a.s_acctbal < b.s_acctbal) - (a.s_acctbal > b.s_acctbal)
    return t("supplier", "s_suppkey").sorted(order).limit(20).map(lambda s: {"s_suppkey": s.s_suppkey, "s_acctbal": s.s_acctbal}).frame()


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 17")
def limit_first(t):
    return t("events", "event_id").limit(17).map(lambda e: {"event_id": e.event_id, "event_type": e.event_type}).frame()


@query("SELECT event_id FROM events LIMIT 0")
def limit_zero(t):
    return t("events", "event_id").limit(0).map(lambda e: {"event_id": e.event_id}).frame()


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 25")
def skip_limit(t):
    return t("events", "event_id").skip(25).limit(10).map(lambda e: {"event_id": e.event_id}).frame()


@query("SELECT event_id FROM events WHERE event_type = 'purchase' OR event_type = 'error' ORDER BY event_id LIMIT 1")
def find_first(t):
    return t("events", "event_id").filter(lambda e: e.event_type.isin("purchase", "error")).map(lambda e: {"event_id": e.event_id}).find_first(frame=True)


@query("SELECT count(1) AS n FROM (SELECT 1 FROM events LIMIT 1)")
def find_any(t):
    return t("events").find_any(frame=True).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(bool_or(coalesce(value > 1000, false)), false) AS r FROM events")
def any_match(t):
    return t("events").any_match(lambda e: e.value > 1000, frame=True)


@query("SELECT coalesce(bool_and(coalesce(l_quantity > 0, false)), true) AS r FROM lineitem")
def all_match(t):
    return t("lineitem").all_match(lambda x: x.l_quantity > 0, frame=True)


@query("SELECT NOT coalesce(bool_or(coalesce(l_discount > 1, false)), false) AS r FROM lineitem")
def none_match(t):
    return t("lineitem").none_match(lambda x: x.l_discount > 1, frame=True)


@query("SELECT coalesce(bool_and(coalesce(l_quantity > 0, false)), true) AS r FROM lineitem WHERE false")
def all_match_empty(t):
    return t("lineitem").filter("false").all_match(lambda x: x.l_quantity > 0, frame=True)


@query("SELECT coalesce(bool_and(coalesce(l_quantity > 0, false)), true) AS r FROM lineitem")
def all_match_python(t):
    return t("lineitem").all_match(py(lambda x: x.l_quantity > 0), frame=True)


@query("SELECT count(1) AS n FROM lineitem")
def count(t):
    return t("lineitem").count(frame=True)


@query("SELECT 100 + coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS r FROM lineitem")
def reduce_identity_sum(t):
    """A2: a known associative operation is an aggregate."""
    return t("lineitem").collect(summing_int(lambda x: x.l_linenumber.cast("long")), frame=True).select((F.col("r") + 100).cast("long").alias("r"))


@query("SELECT max(event_id) AS r FROM events WHERE false")
def reduce_no_identity_empty(t):
    return t("events", "event_id").filter("false").map(lambda e: e.event_id).reduce(lambda a, b: F.greatest(a, b), frame=True)


@query("SELECT list_reduce(list(user_id ORDER BY event_id), lambda a, e: (a * 31 + e) % 1000003, CAST(7 AS BIGINT)) AS r FROM events")
def reduce_ordered_fold(t):
    return t("events", "event_id").map(lambda e: e.user_id).reduce(F.lit(7).cast("long"), lambda a, e: (a * 31 + e) % 1000003, frame=True)


@query("SELECT p_partkey AS k FROM part ORDER BY p_size, p_partkey LIMIT 1")
def min_first_tied(t):
    return t("part", "p_partkey").min(by(lambda p: p.p_size), frame=True).select(F.col("r.p_partkey").alias("k"))


@query("SELECT p_partkey AS k FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def max_first_tied(t):
    return t("part", "p_partkey").max(by(lambda p: p.p_size), frame=True).select(F.col("r.p_partkey").alias("k"))


@query("SELECT coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS s FROM lineitem")
def summing_long(t):
    return t("lineitem").collect(summing_int(lambda x: x.l_linenumber), frame=True).select(F.col("r").cast("long").alias("s"))


@query("SELECT CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS s FROM lineitem")
def summing_doubles(t):
    return t("lineitem").collect(summing_int(lambda x: money(x.l_extendedprice)), frame=True).select(F.col("r").cast("double").alias("s"))


@query("SELECT round(coalesce(sum(l_tax), 0), 4) AS s FROM lineitem")
def summing_double_tax(t):
    return t("lineitem").collect(summing_double(lambda x: x.l_tax), frame=True).select(F.round("r", 4).alias("s"))


@query("SELECT coalesce(round(avg(l_linenumber), 6), 0.0) AS a FROM lineitem")
def averaging_ints(t):
    return t("lineitem").collect(averaging_int(lambda x: x.l_linenumber), frame=True).select(F.round("r", 6).alias("a"))


@query("SELECT coalesce(avg(l_linenumber), CAST(0 AS DOUBLE)) AS a FROM lineitem WHERE false")
def averaging_empty(t):
    return named(t("lineitem").filter("false").collect(averaging_int(lambda x: x.l_linenumber), frame=True), r="a")


@query("SELECT count(1) AS n, coalesce(CAST(sum(p_size) AS BIGINT), 0) AS total, min(p_size) AS lo, max(p_size) AS hi, coalesce(round(avg(p_size), 6), 0.0) AS mean FROM part")
def summarizing_ints(t):
    r = t("part").collect(summarizing_int(lambda p: p.p_size), frame=True)
    return r.select(F.col("r.count").alias("n"), F.col("r.sum").cast("long").alias("total"), F.col("r.min").alias("lo"), F.col("r.max").alias("hi"), F.round("r.average", 6).alias("mean"))


@query("SELECT coalesce(CAST(sum(length(r_name)) AS BIGINT), 0) AS r FROM region")
def reducing_mapped(t):
    return t("region", "r_regionkey").collect(reducing(F.lit(0).cast("long"), lambda r: F.length(r.r_name).cast("long"), lambda a, b: a + b), frame=True)


@query("SELECT r_regionkey AS k, r_name AS v FROM region")
def to_map_unique(t):
    return named(t("region").collect(to_map(lambda r: r.r_regionkey, lambda r: r.r_name), frame=True), k="k", r="v")


@query("SELECT p_brand AS k, list_reduce(list(CAST(p_size AS BIGINT) ORDER BY p_partkey), lambda a, e: (a * 7 + e) % 10007) AS v FROM part GROUP BY p_brand")
def to_map_merge(t):
    return named(t("part", "p_partkey").collect(to_map(lambda p: p.p_brand, lambda p: p.p_size.cast("long"), lambda a, e: (a * 7 + e) % 10007), frame=True), k="k", r="v")


@query("SELECT list(r_name ORDER BY r_regionkey) AS l FROM region")
def to_list_ordered(t):
    return named(t("region", "r_regionkey").map(lambda r: r.r_name).collect(to_list(), frame=True), r="l")


@query("SELECT list_sort(list(DISTINCT event_type)) AS s FROM events")
def to_set_sorted(t):
    return t("events").map(lambda e: e.event_type).collect(to_set(), frame=True).select(F.array_sort("r").alias("s"))


@query("SELECT concat('[', coalesce(string_agg(r_name, ', ' ORDER BY r_regionkey), ''), ']') AS j FROM region")
def joining_names(t):
    return named(t("region", "r_regionkey").map(lambda r: r.r_name).collect(joining(", ", "[", "]"), frame=True), r="j")


@query("SELECT concat('[', coalesce(string_agg(r_name, ', ' ORDER BY r_regionkey), ''), ']') AS j FROM region WHERE false")
def joining_empty(t):
    return named(t("region", "r_regionkey").filter("false").map(lambda r: r.r_name).collect(joining(", ", "[", "]"), frame=True), r="j")


@query("SELECT event_type AS k, count(1) AS n FROM events GROUP BY event_type")
def grouping_by_counting(t):
    return named(t("events").collect(grouping_by(lambda e: e.event_type, counting()), frame=True), k="k", r="n")


@query("SELECT l_returnflag AS k, count(1) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def grouping_by_summarizing(t):
    r = t("lineitem").filter(lambda x: x.l_quantity > 25).collect(grouping_by(lambda x: x.l_returnflag, summarizing_int(lambda x: money(x.l_extendedprice))), frame=True)
    return r.select("k", F.col("r.count").alias("n"), F.col("r.sum").cast("double").alias("total"), F.col("r.min").cast("double").alias("lo"), F.col("r.max").cast("double").alias("hi"))


@query("SELECT l_returnflag AS k, count(1) AS n, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
def grouping_by_doubles(t):
    r = t("lineitem").collect(grouping_by(lambda x: x.l_returnflag, summarizing_double(lambda x: x.l_tax)), frame=True)
    return r.select("k", F.col("r.count").alias("n"), F.col("r.min").alias("lo"), F.col("r.max").alias("hi"))


@query("SELECT l_returnflag AS k1, l_linestatus AS k2, count(1) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def grouping_by_nested(t):
    return named(t("lineitem").collect(grouping_by(lambda x: x.l_returnflag, grouping_by(lambda x: x.l_linestatus, counting())), frame=True), k1="k1", k2="k2", r="n")


@query("SELECT n_regionkey AS k, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey")
def grouping_by_list(t):
    return named(t("nation", "n_nationkey").collect(grouping_by(lambda n: n.n_regionkey, mapping(lambda n: n.n_name, to_list())), frame=True), k="k", r="l")


@query("SELECT lang AS k, list_sort(list(DISTINCT upper(source))) AS s FROM documents GROUP BY lang")
def grouping_by_mapping(t):
    r = t("documents").collect(grouping_by(lambda d: d.lang, mapping(lambda d: F.upper(d.source), to_set())), frame=True)
    return r.select("k", F.array_sort("r").alias("s"))


@query("SELECT b.k AS k, coalesce(g.n, 0) AS n FROM (SELECT true AS k UNION ALL SELECT false) b LEFT JOIN (SELECT coalesce(value > 1000, false) AS k, count(1) AS n FROM events GROUP BY coalesce(value > 1000, false)) g ON b.k = g.k")
def partitioning_by_counting(t):
    return named(t("events").collect(partitioning_by(lambda e: e.value > 1000, counting()), frame=True), k="k", r="n")


@query("SELECT event_type, event_id AS k FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1")
def max_by_grouped(t):
    r = t("events", "event_id").collect(grouping_by(lambda e: e.event_type, max_by(by(lambda e: e.value))), frame=True)
    return r.select(F.col("k").alias("event_type"), F.col("r.event_id").alias("k"))


@query("SELECT event_type, event_id AS k FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) = 1")
def min_by_grouped(t):
    r = t("events", "event_id").collect(grouping_by(lambda e: e.event_type, min_by(by(lambda e: e.value))), frame=True)
    return r.select(F.col("k").alias("event_type"), F.col("r.event_id").alias("k"))


@query("SELECT CAST(length(coalesce(string_agg(n_name, '|' ORDER BY n_nationkey), '')) AS INTEGER) AS r FROM nation")
def collecting_and_then_length(t):
    return t("nation", "n_nationkey").map(lambda n: n.n_name).collect(collecting_and_then(joining("|"), F.length), frame=True)


@query("WITH RECURSIVE it(n, x) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, (x * 3) % 1009 FROM it WHERE n < 149) SELECT n, x FROM it")
def iterate_lcg(t):
    df = Pipeline.iterate((0, 1), lambda s: (s[0] + 1, s[1] * 3 % 1009)).limit(150).map(py(lambda s: s, "struct<n:int,x:bigint>")).frame()
    return df.select("v.n", "v.x")


@query("SELECT list(r_name ORDER BY r_regionkey) AS v FROM region")
def custom_collector(t):
    """C0: a collector of Python parts folds on the driver; its result comes back as a relation."""
    got = t("region", "r_regionkey").collect(Collector(list, lambda c, r: c.append(r.r_name)))
    return _values([got], "array<string>")


@query("SELECT list(r_name ORDER BY r_name) AS v FROM region")
def to_collection_sorted(t):
    class Sorted(list):
        def add(self, x):
            self.append(x)
            self.sort()

    return _values([list(t("region", "r_regionkey").map(lambda r: r.r_name).collect(to_collection(Sorted)))], "array<string>")


@query("SELECT list(n_name ORDER BY n_nationkey) AS v FROM nation")
def for_each_ordered(t):
    log: list = []
    t("nation", "n_nationkey").parallel().for_each_ordered(lambda n: log.append(n.n_name))
    return _values([log], "array<string>")


@query("SELECT n_name AS v FROM nation")
def iterator(t):
    return _values([n.n_name for n in t("nation", "n_nationkey").iterator()], "string")


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem")
def reduce_combiner(t):
    """A4, an extension: partitions fold apart, a combiner joins them."""
    got = t("lineitem").unordered().map(lambda x: x.l_linenumber).reduce(0, lambda a, b: a + b, lambda a, b: a + b)
    return _values([got], "long")


@query("SELECT p_size AS v FROM part ORDER BY p_size LIMIT 30")
def sorted_natural(t):
    """O1: natural order of the elements."""
    return t("part", "p_partkey").map(lambda p: p.p_size).sorted().limit(30).frame()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
def unordered_sorted_topk(t):
    """L3: unordered() frees the source's order; a sort holds."""
    return t("orders").unordered().sorted(by(lambda o: o.o_totalprice).then(lambda o: o.o_orderkey)).limit(7).map(lambda o: {"o_orderkey": o.o_orderkey}).frame()


@query("SELECT list(s_suppkey ORDER BY s_acctbal DESC, s_suppkey) AS v FROM supplier")
def parallel_sorted_iterator(t):
    """L1, L4: sorted is global in parallel mode too."""
    order = by(lambda s: s.s_acctbal, desc=True).then(lambda s: s.s_suppkey)
    return _values([[s.s_suppkey for s in t("supplier", "s_suppkey").parallel().sorted(order).iterator()]], "array<long>")


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 40")
def skip_only(t):
    """O5: a skip without a limit."""
    return t("events", "event_id").skip(40).map(lambda e: {"event_id": e.event_id}).unordered().frame()


@query("SELECT list(n_name ORDER BY n_nationkey) AS v FROM nation")
def to_array_ordered(t):
    """A8."""
    return _values([t("nation", "n_nationkey").map(lambda n: n.n_name).to_array()], "array<string>")


@query("SELECT list(r_name ORDER BY r_regionkey) AS v FROM region")
def to_generator_ordered(t):
    """C21."""
    return _values([list(t("region", "r_regionkey").map(lambda r: r.r_name).collect(to_generator))], "array<string>")


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem")
def collect_combined(t):
    """A6: supplier, accumulator and combiner; partitions fold apart."""

    def add(c, x):
        c[0] += x

    def both(a, b):
        a[0] += b[0]

    return _values([t("lineitem").unordered().map(lambda x: x.l_linenumber).collect(lambda: [0], add, both)[0]], "long")


@query("SELECT list(x ORDER BY x) AS v FROM (SELECT r_name AS x FROM region)")
def for_each_any_order(t):
    """L7."""
    log: list = []
    t("region").unordered().parallel().for_each(lambda r: log.append(r.r_name))
    return _values([sorted(log)], "array<string>")


@query("SELECT p_partkey * 10 + i AS v FROM part, (SELECT unnest([0, 1]) AS i) WHERE i < p_partkey % 3")
def flat_map_python(t):
    """P3, Python lane."""
    return t("part", "p_partkey").flat_map(py(lambda p: [p.p_partkey * 10 + i for i in range(min(2, p.p_partkey % 3))], "long")).unordered().frame()


@query("SELECT count(DISTINCT user_id % 97) AS n FROM events")
def distinct_objects(t):
    """U2 by Python's own equality."""
    return t("events", "event_id").map(py(lambda e: (e.user_id % 97, "k"))).distinct().count(frame=True)


@query("SELECT unnest(range(3, 33, 3)) AS v")
def iterate_filter_limit(t):
    """S8, T3: an endless source under a filter."""
    return Pipeline.iterate(1, lambda x: x + 1).filter(lambda x: x % 3 == 0).limit(10).frame()


@query("SELECT true AS v")
def iterate_any_match(t):
    return _values([Pipeline.iterate(1, lambda x: x * 2).any_match(lambda x: x > 1000)], "boolean")


@query("SELECT unnest([0, 1, 4, 9]) AS v")
def of_generator(t):
    """S3: a generator without end, and S4: values with __next__ alone."""

    class Next:
        at = -1

        def __next__(self):
            self.at += 1
            return self.at

    one = Pipeline.of(Next()).map(py(lambda x: x * x, "long")).limit(2)
    two = Pipeline.of(x for x in itertools.count(2)).flat_map(lambda x: [x * x]).limit(2)
    return Pipeline.concat(one, two).frame()


async def _feed():
    for i in itertools.count():
        yield i


@query("SELECT unnest([1, 3, 5]) AS v")
def of_async_feed(t):
    """S5: an asynchronous feed without end."""
    return Pipeline.of(_feed()).filter(lambda x: x % 2).limit(3).frame()


@query("SELECT unnest(['abc', 'd', 'e']) AS v")
def of_scalars(t):
    """S1, S6, S7, S9."""
    return Pipeline.concat(Pipeline.concat(Pipeline.of("abc"), Pipeline.empty()), Pipeline.builder().add("d").add("e").build()).map(py(lambda s: s, "string")).frame().select("v")


@query("SELECT 'ValueError' AS v")
def exception_type(t):
    """L9: a user's exception from an executor reaches the caller as it is."""

    def bad(r):
        raise ValueError("boom")

    try:
        t("region").map(py(bad, "long")).count()
        for _ in t("region").map(py(bad, "long")).iterator():
            pass
    except Exception as e:
        return _values([type(e).__name__], "string")


@query("SELECT list(n_name ORDER BY n_nationkey) AS v FROM nation WHERE n_regionkey = 1")
def life_cycle(t):
    """L2, L5, L6: flags, close handlers in order, a reference serves once."""
    log: list = []
    p = t("nation", "n_nationkey").on_close(lambda: log.append("a")).on_close(lambda: log.append("b"))
    q = p.parallel().sequential().filter(lambda n: n.n_regionkey == 1)
    try:
        p.count()
    except PipelineStateError:
        log.append("used")
    names = [n.n_name for n in q.iterator()]
    q.close()
    return _values([names if log == ["used", "a", "b"] and not q.is_parallel() else []], "array<string>")


def _values(values, kind: str):
    from ..sources import session

    return session().createDataFrame([(v,) for v in values], f"v {kind}")
