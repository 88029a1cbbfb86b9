"""Packing: shortest-pack-first over the histogram of piece lengths.

Texts become ids, ids become pieces of at most `cap`; the histogram of their lengths (at most `cap` rows) is packed on
the driver, longest length first, each into the packs that are shortest so far; the resulting patterns go back to the
pieces by rank within their length.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import AT_ONCE, batches, encoder
from .common import only, stored

#: Kept ids of words; less than the encoder's default, as packing runs in the pipeline beside a heap that earlier stages grew.
CACHE_BYTES = 48 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer_path: str, cap: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and end id; null text is empty. ids (little-endian uint32) are null unless asked for."""

    def cut(rows):
        enc, end = only(encoder(tokenizer_path, CACHE_BYTES)), np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())])
        for batch in rows:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts, AT_ONCE // 4, 1 << 14):
                out = []
                for i, raw in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    raw += end
                    for at in range(0, len(raw), 4 * cap):
                        own = raw[at : at + 4 * cap]
                        out.append((i, at // 4, len(own) // 4, zlib.crc32(own), len(raw) // 4, own if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, count) for a histogram {length: count} with lengths from 1 to cap.

    Lengths go longest first; the shortest packs that still have room get them. When none has room, new packs hold as
    many of that length as fit. A length ends at most one run of equal packs early, so there are at most a few
    patterns for each length, whatever the counts.
    """
    room: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern, count):
        if not count:
            return
        left = cap - sum(pattern)
        if left:
            room.setdefault(left, []).append([pattern, count])
        else:
            done.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            left = max(room, default=0)
            if left < length:
                each = cap // length
                put((length,) * each, n // each)
                put((length,) * (n % each), int(n % each > 0))
                break
            pattern, count = room[left].pop()
            if not room[left]:
                del room[left]
            used = min(n, count)
            put(pattern, count - used)
            put((*pattern, length), used)
            n -= used
    return done + [(p, c) for left in sorted(room) for p, c in room[left]]


def pack(docs: DataFrame, tokenizer_path: str, cap: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id (from 0) and offset. Rows with equal or null ids are packed one by one; an empty table gives
    no rows; null text is empty (its end id alone); other columns are ignored, whatever their names. A text of any length
    is cut into pieces in one task, whose memory grows with that text.

    Gathered on the driver: the histogram only, at most cap rows. The rank of a piece within its length is its rank in
    (length, salt) plus the counts of earlier salts, so a length that a third of all pieces have is no single group.
    """
    cut = stored(pieces(docs, tokenizer_path, cap, end_id, with_ids), "pieces")
    n = cut.count()
    salts = max(1, math.isqrt(n))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = stored(cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, count in shortest_pack_first(histogram, cap):
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    table = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}
    table = docs.sparkSession.sparkContext.broadcast(table)

    def place(rows):
        for batch in rows:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                t = table.value[int(length[own[0]])]
                k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                seq[own], off[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    names = [f.name for f in cut.schema if f.name not in ("salt",) and (with_ids or f.name != "ids")]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own)).join(before, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(place, PIECES.replace(", ids binary", ", ids binary" * with_ids) + ", sequence_id long, offset long")
