"""Token counts by byte-pair merging over a heap and a linked list; no ids are made.

A pre-token starts as its bytes. A heap holds (rank, position) of adjacent pairs, a doubly linked list the symbols; the
least rank merges first, at equal rank the leftmost. Count: first symbols minus merges.
"""

from __future__ import annotations

import functools
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ALPHABET, batches
from .common import Cache, only

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeCounter:
    """Counts tokens of whole texts; most_bytes bounds the chunks kept in memory."""

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.chunks = spec["model"]["vocab"], Cache(most_bytes)
        self.first = [vocab[chr(ALPHABET.get(b, b))] for b in range(256)]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.find = regex.compile(PRE_TOKEN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def forget(self) -> None:
        self.chunks.clear()

    def merged(self, data: bytes) -> int:
        """Symbols that are left of one pre-token's bytes."""
        sym, ranks = [self.first[b] for b in data], self.ranks
        n = left = len(sym)
        if n < 2:
            return n
        heap = [got[0] << 32 | i for i in range(n - 1) if (got := ranks.get(sym[i] << 32 | sym[i + 1]))]
        if not heap:
            return n
        heapq.heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = nxt[i]
            if sym[i] < 0 or j >= n:
                continue
            got = ranks.get(sym[i] << 32 | sym[j])
            if got is None or got[0] != top >> 32:
                continue  # one of the two has merged since
            sym[i], sym[j] = got[1], -1
            left -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if got := ranks.get(sym[i] << 32 | sym[k]):
                    heapq.heappush(heap, got[0] << 32 | i)
            if (p := prv[i]) >= 0 and (got := ranks.get(sym[p] << 32 | sym[i])):
                heapq.heappush(heap, got[0] << 32 | p)
        return left

    def whole(self, text: str) -> int:
        """Count of a text without regard to chunks; special strings count one each."""
        n = 0
        if self.special is not None and self.special.search(text):
            n, text = len(self.special.findall(text)), self.special.split(text)
        else:
            text = [text]
        merged = self.merged
        return n + sum(merged(t.encode()) for part in text for t in self.find(part))

    def count(self, text: str) -> int:
        head, *rest = text.split(" ")
        if head[-1:].isspace():
            return self.whole(text)
        get, chunks = self.chunks.get, self.chunks
        found = list(map(get, rest))
        if None in found:
            for k, (w, v) in enumerate(zip(rest, found, strict=True)):
                if v is None:
                    if (v := get(w)) is None:
                        v = chunks.keep(w, -1 if not w or w[0].isspace() or w[-1].isspace() else self.whole(" " + w))
                    found[k] = v
        return self.whole(text) if -1 in found else sum(found) + (self.whole(head) if head else 0)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of docs; no shuffle.

    Null text is empty (no bytes, no tokens); null and repeated ids keep a row each; an empty table gives no rows; other
    columns are ignored, whatever their names. A text is counted whole, however long: a word's memory grows with the
    word, what is kept between words is bounded.
    """

    def count(rows):
        own = only(counter(tokenizer_path))
        for batch in rows:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts, most=4096):
                n = [own.count(t) for t in texts[a:b]]
                size = [len(t.encode()) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
