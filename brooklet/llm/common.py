"""Helpers shared by the corpus operators: shared tables, connected components, bounded per-process caches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's switch that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and outlives executors.

    The write's shuffle files go when it has ended, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    for made in _open:
        made.spark = spark
        made.paths.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


class Made:
    """Shared tables written since tables() began."""

    def __init__(self):
        self.paths: list[str] = []
        self.spark: SparkSession | None = None

    def release(self, *keep: DataFrame) -> None:
        """Remove all tables but those of keep: they must not be read by anything that is still to run."""
        kept = {getattr(df, "_llm_path", None) for df in keep}
        for path in [p for p in self.paths if p not in kept]:
            removed(self.spark, path)
            for made in _open:
                with contextlib.suppress(ValueError):
                    made.paths.remove(path)


_open: list[Made] = []


@contextlib.contextmanager
def tables():
    """Notes the shared tables that are written inside, so that they can be removed once what replaces them is committed."""
    made = Made()
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    removed(df.sparkSession, df._llm_path)
    for made in _open:
        with contextlib.suppress(ValueError):
            made.paths.remove(df._llm_path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Plans made inside send at most so many rows at once to Python: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Cache(dict):
    """Values by words or chunks, for one Python process: starts anew beyond most_bytes; keys over `longest` characters,
    such as texts without spaces, aren't kept at all."""

    def __init__(self, most_bytes: int = 64 << 20, longest: int = 256):
        self.most_bytes, self.longest, self.used = most_bytes, longest, 0

    def clear(self) -> None:
        super().clear()
        self.used = 0

    def keep(self, key, value, size: int = 0):
        """value, kept if its key isn't too long; size: bytes of value beside those of a small object."""
        if len(key) <= self.longest:
            self.used += sys.getsizeof(key) + size + 120
            if self.used > self.most_bytes:
                self.clear()
            self[key] = value
        return value


_filled: list = []


def only(owner=None):
    """Called by a task before it fills the caches of owner: what other operators keep in this Python process goes, as
    workers outlive their stage."""
    for other in _filled:
        if other is not owner:
            other.forget()
    _filled[:] = [owner] if owner is not None else []
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # what was freed goes back to the system, where its library can do so
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    return owner


def held_out(doc_id: str = "doc_id"):
    """Column: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Edges up to which the least neighbours of all nodes (two a edge at most, 16 bytes and a hash entry each) are broadcast.
BROADCAST_EDGES = 250_000


def _least(edges: DataFrame, few: bool) -> DataFrame:
    out = edges.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(out) if few else out


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, few)
    moved = both.where("v > u").join(least, "u").select("v", F.least("u", "m").alias("m"))
    return moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, few)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, tag: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component), component the least node reachable.

    Alternating large-star and small-star steps; only minima are gathered per node, never neighbour lists, so a node
    with a third of all edges needs no large group, and up to BROADCAST_EDGES edges its rows don't meet in a task
    either (beyond, the join by node can be split as its other side has one row a node). Each step's table goes to the
    shared folder and replaces the one before. Nodes without an edge don't appear. Nulls and loops are ignored.
    """
    now = stored(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), tag)
    n, mark = now.count(), None
    for _ in range(most):
        few = n <= BROADCAST_EDGES
        new = stored(_small_star(_large_star(now, few), few).distinct(), tag)
        discard(now)
        now = new
        row = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if row == mark:
            break
        mark, n = row, row[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
