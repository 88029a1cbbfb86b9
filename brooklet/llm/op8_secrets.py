"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds (fixed patterns) are always reported. Candidates of the kind `opaque` (long runs that mix cases and digits)
are hashed and aggregated by distinct repositories and owners over the whole corpus: those that many owners hold are
copied examples, those that few hold look like live credentials and add spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Kind, pattern, group that holds the value, least characters of that group.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates that ownership decides on.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
ITEM = "struct<start:bigint,stop:bigint,rank:int,kind:string,value:string>"
SPAN = f"array<{ITEM}>"


#: Rows of a list that are folded at once: appending to a list copies it, so long lists are made of blocks.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once: a lambda's argument is, an expression inside a lambda isn't."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(rows: Column, made: str, step, around=None) -> Column:
    """Outputs of step(state, row) -> struct(at bigint, found), folded over rows with a running position; block by block,
    so the work grows with the rows and their blocks. found: list of what is made. around(state, block, fold) may put
    something round a block's fold."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / BLOCK).cast("int"))
    kind = f"struct<at:bigint,found:array<{made}>>"

    def one(done, k):
        at = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0).cast("bigint"))
        zero = F.struct(at.alias("at"), F.array().cast(f"array<{made}>").alias("found"))
        fold = lambda own, f=step: F.aggregate(own, zero, f)
        own = F.slice(rows, k * BLOCK + 1, BLOCK)
        return F.array_append(done, around(at, own, fold) if around else fold(own))

    return F.aggregate(blocks, F.array().cast(f"array<{kind}>"), one)


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches: their lengths and those of the pieces between add up to positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("b"), whole.alias("w"))

    def step(acc, r):
        start = acc["at"] + r["b"]
        stop = start + F.length(r["w"])
        value = F.regexp_extract(r["w"], pattern, group) if group else r["w"]
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("value"))
        found = F.when(F.length(value) >= least, F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct(F.coalesce(stop, start).alias("at"), found.alias("found"))

    spans = _bound(rows, lambda r: F.flatten(F.transform(_running(r, ITEM, step), lambda x: x["found"])))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _mixed(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def find_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 1, most_repositories: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, text_key (xxhash64 of the text), base and added spans (start, stop, rank, kind, value), in order of start and kind.

    An opaque candidate adds a span if at most most_owners owners and most_repositories repositories hold its hash in
    the whole corpus and it overlaps no base span. Null text has no spans; a null owner counts as one owner of its own;
    repeated rows are scanned each, and count once as repository. Ownership counts go through (hash, owner,
    repository) first, so a copied example makes no large group.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\0null")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("\0null")).alias("repository"),
    )
    base = F.concat(*(_matches(F.col("text"), *k, rank=i) for i, k in enumerate(BASE)))
    opaque = F.filter(_matches(F.col("text"), *OPAQUE, rank=len(BASE)), lambda s: _mixed(s["value"]))
    found = own.select("doc_id", F.xxhash64("text").alias("text_key"), "owner", "repository", F.array_sort(base).alias("base"), opaque.alias("maybe"))
    clear = F.filter("maybe", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    found = stored(found.withColumn("maybe", clear).withColumn("row", F.monotonically_increasing_id()), "spans")
    single = found.where(F.size("maybe") > 0).select("row", "owner", "repository", F.explode("maybe").alias("span"))
    single = single.withColumn("hash", F.sha2("span.value", 256))
    held = single.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    verdict = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    live = verdict.where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("hash")
    added = single.join(live, "hash").groupBy("row").agg(F.collect_list("span").alias("added"))
    out = found.select("row", "doc_id", "text_key", "base").join(added, "row", "left")
    return out.select("doc_id", "text_key", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_report(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per row of docs, as find_spans says; spans by kind:start:end.

    Empty and null texts have no spans and the hash of nothing; an empty table gives no rows. Work grows with a text's
    length and matches, however many. Other columns are ignored, whatever their names.
    """
    found = find_spans(docs, owner)

    def count_of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [count_of(k[0]) for k in BASE]
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with every span (sorted by start, possibly overlapping) replaced by mark; null text stays null, and no span
    changes nothing. A block of spans is cut out of the text first, as a position is found by reading up to it."""

    def cut(whole, first, last):
        return F.substring(whole, (first + 1).cast("int"), (last - first).cast("int"))

    def around(at, own, fold):
        def inside(at_):
            stop = F.array_max(F.transform(own, lambda s: s["stop"]))

            def step(piece):
                def one(acc, s):
                    parts = F.concat(acc["found"], F.array(cut(piece, acc["at"] - at_, s["start"] - at_), F.lit(mark)))
                    return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], parts).otherwise(acc["found"]).alias("found"))

                return F.aggregate(own, F.struct(at_.alias("at"), F.array().cast("array<string>").alias("found")), one)

            return _bound(cut(text, at_, F.greatest(stop, at_)), step)

        return _bound(at, inside)

    def close(done):
        last = F.get(done, F.size(done) - 1)["at"]
        return F.concat(F.array_join(F.flatten(F.transform(done, lambda x: x["found"])), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, _bound(_bound(spans, lambda s: _running(s, "string", None, around)), close)).otherwise(text)
