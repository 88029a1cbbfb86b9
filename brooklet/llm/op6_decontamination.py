"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage by block-max WAND.

Impacts are divided by the item's own score, so 1 is a passage that holds the whole item and one threshold serves all
items. What is retrieved is verified: the item's question and its answer must both overlap the passage in word shingles.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, only, stored

EDGES = "\"'`“”„«»‘’()[]{}<>.,;:!?…%&*#$-_/\\|~^+="
BLOCK = 8
K1, B = 1.2, 0.75


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item given as one text: the answer is its last sentence or line, else its second half."""
    cut = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text.strip())]
    for at in reversed(cut):
        q, a = words_of(text.strip()[:at]), words_of(text.strip()[at:])
        if len(a) >= 3 and q:
            return q, a
    w = words_of(text)
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def shingles(words: list[str], size: int = 5) -> set[tuple[str, ...]]:
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class Index:
    """Items of similar length in at most 64 blocks, each with its own postings; maxima[t, block] bounds a term's impact there.

    terms maps words to numbers from 1 on and is shared by the indexes of a benchmark.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], terms: dict[str, int], idf: dict[str, float], mean: float, longest: int):
        self.items = items
        self.size = max(BLOCK, -(-len(items) // 64))
        self.longest = longest
        self.blocks: list[dict[int, tuple[list[int], list[float], float]]] = []
        self.maxima = np.zeros((len(terms) + 1, -(-len(items) // self.size)), dtype=np.float32)
        for first in range(0, len(items), self.size):
            post: dict[int, list[tuple[int, float]]] = {}
            for i in range(first, min(first + self.size, len(items))):
                w = [*items[i][1], *items[i][2]]
                bag = Counter(w)
                hit = {x: idf[x] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for x, f in bag.items()}
                own = sum(hit.values())
                for x, v in hit.items():
                    post.setdefault(terms[x], []).append((i, v / own))
            self.blocks.append({t: ([x[0] for x in p], [x[1] for x in p], max(x[1] for x in p)) for t, p in post.items()})
            for t, p in self.blocks[-1].items():
                self.maxima[t, len(self.blocks) - 1] = p[2]

    def search(self, block: int, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items of a block that score at least `least` for distinct terms: WAND pivots under a fixed threshold."""
        lists = [[0, *p] for t in terms if (p := self.blocks[block].get(t))]  # position, ids, impacts, bound
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[3]
                if total >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][1][lists[pivot][0]]
            goal = item
            if lists[0][1][lists[0][0]] == item:
                s = sum(x[2][x[0]] for x in lists if x[1][x[0]] == item)
                if s >= least - 1e-9:
                    out.append((item, s))
                goal = item + 1
            for x in lists:
                p, ids = x[0], x[1]
                while p < len(ids) and ids[p] < goal:
                    p += 1
                x[0] = p
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    def passages(self, terms: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(start, stop, block) where the block's maxima over the passage's words reach `least`.

        Passages step by a quarter of the longest item and are that much longer, so each run of words as long as an
        item lies in one whole. A word's repeat within a step counts once, which leaves the sum a bound.
        """
        step = max(1, self.longest // 4)
        size, out = self.longest + step, []
        part = max(64 * size, 1 << 14) // step * step
        for at in range(0, max(1, len(terms) - size + step), part):
            own = terms[at : at + part + size]
            n = len(own)
            weight = self.maxima[own]
            order = np.argsort(own, kind="stable")
            before = np.full(n, -(1 << 40))
            same = own[order[1:]] == own[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            zero = np.zeros((1, weight.shape[1]), dtype=np.float32)
            a = np.concatenate([zero, np.cumsum(weight, axis=0)])
            weight[before >= np.arange(n) - step] = 0
            b = np.concatenate([zero, np.cumsum(weight, axis=0)])
            start = np.arange(0, min(part, max(1, n - size + step)), step)
            mid, stop = np.minimum(start + step, n), np.minimum(start + size, n)
            top = a[mid] - a[start] + b[stop] - b[mid]
            for k, block in zip(*np.nonzero(top >= least - 1e-2), strict=True):
                out.append((at + int(start[k]), at + int(stop[k]), int(block)))
        return out


class Numbers(Cache):
    """Term numbers of raw words: 0 for a word that no item has, -1 for marks alone."""

    def __init__(self, terms: dict[str, int], most_bytes: int):
        super().__init__(most_bytes)
        self.terms = terms

    def __missing__(self, raw: str) -> int:
        word = raw.strip(EDGES)
        return self.keep(raw, self.terms.get(word, 0) if word else -1)


class Benchmark:
    """All items, one index for each doubling of their length, so that passages fit and short items don't loosen the bounds of long ones.

    Where items are a block of a benchmark, whole holds the statistics of all of it: document frequencies of (at least)
    the block's words, number of items, mean length, and the longest item of each doubling. Scores and passages are then
    those of one index of all items.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], most_bytes: int = 64 << 20, whole: tuple[dict[str, int], int, float, dict[int, int]] | None = None):
        items = [x for x in items if x[1] or x[2]]
        self.terms: dict[str, int] = {}
        self.words = Numbers(self.terms, most_bytes)
        own: dict[int, list] = {}
        for x in items:
            own.setdefault((len(x[1]) + len(x[2])).bit_length(), []).append(x)
        if whole is None:
            sizes = [len(q) + len(a) for _, q, a in items]
            whole = Counter(w for _, q, a in items for w in {*q, *a}), len(items), sum(sizes) / max(1, len(items)), {k: max(len(q) + len(a) for _, q, a in v) for k, v in own.items()}
        df, n, mean, longest = whole
        for w in {w: 0 for _, q, a in items for w in (*q, *a)}:
            self.terms[w] = len(self.terms) + 1
        idf = {w: float(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) for w in self.terms}
        self.indexes = [Index(own[k], self.terms, idf, mean, longest[k]) for k in sorted(own)]

    def forget(self) -> None:
        self.words.clear()

    def look(self, text: str) -> np.ndarray:
        """Term numbers of the words of text, 0 where no item has them; words of marks alone are left out."""
        raw = text.lower().split()
        out = np.fromiter(map(self.words.__getitem__, raw), dtype=np.int64, count=len(raw))
        return out[out >= 0] if len(out) and out.min() < 0 else out

    def matches(self, text: str, least: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap): verified items of a text, the best passage of each."""
        terms, words = self.look(text), None
        out = []
        for index in self.indexes if len(terms) else ():
            best: dict[int, tuple[float, float, float]] = {}
            for start, stop, block in index.passages(terms, least):
                for item, s in index.search(block, [t for t in set(terms[start:stop].tolist()) if t], least):
                    words = words or words_of(text)
                    q, a = index.items[item][1:]
                    share = []
                    for p in (q, a):
                        k, need = min(5, len(p)), shingles(p)
                        there = {tuple(words[i : i + k]) for i in range(start, stop - k + 1)}
                        share.append(len(need & there) / len(need) if need else 1.0)
                    if min(share) >= overlap:
                        best[item] = max(best.get(item, (0, 0, 0)), (s, *share))
            out += [(index.items[i][0], *v) for i, v in best.items()]
        return sorted(out, key=lambda x: (x[0] is None, x))


@functools.lru_cache(maxsize=1)
def _benchmark(key: int, items: bytes) -> Benchmark:
    made, whole = pickle.loads(items)
    return Benchmark(made, whole=whole)


RESULT = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.7, overlap: float = 0.5, block_rows: int = 20_000) -> DataFrame:
    """Rows (doc_id, text_key, item_id, score, question_overlap, answer_overlap) for every document that holds a test item;
    text_key is the xxhash64 of its text, to tell rows with equal or null ids apart.

    Items are taken in blocks of block_rows (by hash of the id), so what is broadcast is bounded; each block's index is
    queried by all passages of all texts, and scores by the statistics of all items. benchmark has item_id and text, or question and answer columns instead of
    text. Null or empty texts match nothing; null ids are carried; repeated items and documents give a row each; an
    empty table on either side gives no rows; other columns are ignored. A text's memory grows with its words.
    """
    spark = docs.sparkSession
    if {"question", "answer"} <= set(benchmark.columns):
        items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))
    else:
        items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")), F.lit(None).cast("string"))
    items = items.toDF("item_id", "q", "a")
    blocks = max(1, -(-items.count() // block_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).where("text is not null and text != ''")
    out, block_of = None, F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(blocks))
    if blocks > 1:
        bags = stored(items.withColumn("block", block_of).mapInArrow(_bags, "block long, word string, size long"), "items")
        df = stored(bags.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df")), "words")
        sizes = bags.where("word is null").groupBy("size").count().collect()
        n, longest = sum(r["count"] for r in sizes), {}
        for r in sizes:
            longest[r["size"].bit_length()] = max(r["size"], longest.get(r["size"].bit_length(), 0))
        mean = sum(r["size"] * r["count"] for r in sizes) / max(1, n)
    for block in range(blocks):
        own, whole = items, None
        if blocks > 1:
            own = items.where(block_of == block)
            words = bags.where((F.col("block") == block) & F.col("word").isNotNull()).select("word").distinct().join(df, "word").collect()
            whole = {r.word: r.df for r in words}, n, mean, longest
        made = [(r.item_id, *_parts(r.q, r.a)) for r in own.orderBy("item_id", "q").collect()]
        sent = spark.sparkContext.broadcast(data := pickle.dumps((made, whole)))
        found = rows.mapInArrow(functools.partial(_run, sent, zlib.crc32(data), least, overlap), RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def _parts(q: str, a: str | None) -> tuple[list[str], list[str]]:
    return parts_of(q) if a is None else (words_of(q), words_of(a))


def _bags(batches):
    """A row of each word of an item, and one without a word that holds the item's length; items without words have none."""
    for batch in batches:
        rows = []
        for q, a, block in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist(), batch.column("block").to_pylist(), strict=True):
            q, a = _parts(q, a)
            if size := len(q) + len(a):
                rows.append((block, None, size))
                rows += [(block, w, size) for w in {*q, *a}]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["block", "word", "size"])


def _run(sent, key, least, overlap, batches):
    index = only(_benchmark(key, sent.value))
    for batch in batches:
        got = [(i, k, *m) for i, t, k in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True) for m in index.matches(t, least, overlap)]
        cols = list(zip(*got, strict=True)) if got else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], names=["doc_id", "text_key", "item_id", "score", "question_overlap", "answer_overlap"])
