"""Token ids as length-delimited binary records with a separate offset index.

Record: uint64 length, uint32 masked checksum of those 8 bytes, payload, uint32 masked checksum of the payload; the
checksum is CRC-32 rotated right by 15 bits plus 0xA282EAD8, all little-endian. Payload: one byte width (2 or 4), then
the ids in that width. Index (one file beside each record file): for each record int64 id, uint8 "id is null", uint64
offset, uint64 length, so that a reader can fetch records in any order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import AT_ONCE, batches, encoder
from .common import only, removed, shared_dir, stored, tables

#: Size of the input, as Spark estimates it, for each file.
PART_BYTES = 32 << 20
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8")])


class DamagedRecord(ValueError):
    """A frame whose lengths or checksums don't hold."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: np.ndarray) -> bytes:
    wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = bytes([wide]) + ids.astype(f"<u{wide}").tobytes()
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(read) -> np.ndarray | None:
    """The next record's ids through read(n); None at the end."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise DamagedRecord("length")
    n = int.from_bytes(head[:8], "little")
    body = read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != int.from_bytes(body[n:], "little"):
        raise DamagedRecord("payload")
    return np.frombuffer(body, dtype=f"<u{body[0]}", offset=1, count=(n - 1) // body[0])


MANIFEST = "part long, file string, n_docs long, n_tokens long"


def _source_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads; sources of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, parts: int = 0) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored) and write them in ascending doc_id order, nulls first.

    Returns the manifest: one row per file that counts. A task that runs again writes files of other names; only those
    in the manifest are valid, so lost executors and speculative tasks leave no half-written data behind. Null text is
    empty (its record holds the end id only); rows with equal ids are adjacent; an empty table gives no files. A text of
    any length is one record. parts: number of files; by default as many as shuffles have partitions, or more, so that
    none stands for over PART_BYTES of input. Records and index are written as they come: a task holds a batch.
    """
    spark = docs.sparkSession
    if not parts:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_source_bytes(docs) // PART_BYTES))

    def write(rows):
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        part, name, out, marks, at, tokens, n = TaskContext.get().partitionId(), "", None, None, 0, 0, 0
        enc, end = only(encoder(tokenizer_path)), np.array([end_id], dtype="<u4").tobytes()
        for batch in rows:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts, AT_ONCE, 1 << 14):
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}"
                    out, marks = (where.open_output_stream(f"{base}/{name}.{x}") for x in ("rec", "idx"))
                index = []
                for i, raw in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    seq = np.frombuffer(raw + end, dtype="<u4")
                    data = frame(seq)
                    out.write(data)
                    index.append((i or 0, i is None, at, len(data)))
                    at, tokens = at + len(data), tokens + len(seq)
                marks.write(np.array(index, dtype=INDEX).tobytes())
                n += len(index)
        if out is not None:
            out.close()
            marks.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n], "n_tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stored(rows.mapInArrow(write, MANIFEST), "records")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files; every frame is checked, and that it lies where the index
    says. A manifest row per file is all that is gathered."""
    spark, known, before = manifest.sparkSession, [], 0
    for r in manifest.orderBy("part").collect():
        known.append((r.file, before))
        before += r.n_tokens

    def read(rows):
        where, base = fs.FileSystem.from_uri(folder)
        for batch in rows:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                with where.open_input_stream(f"{base}/{name}.idx", buffer_size=1 << 20) as marks, where.open_input_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as f:
                    while data := marks.read(10_000 * INDEX.itemsize):
                        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for i, null, offset, length in np.frombuffer(data, dtype=INDEX).tolist():
                            if offset != at or (ids := unframe(f.read)) is None:
                                raise DamagedRecord("the index and the records differ")
                            for k, v in zip(out, (None if null else i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                                out[k].append(v)
                            start, at = start + len(ids), at + length
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))
                    if f.read(1):
                        raise DamagedRecord("more records than the index has")

    files = spark.createDataFrame(known, "file string, before long").repartition(max(1, len(known)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(folder: str, name: str, positions: list[int]) -> list[np.ndarray]:
    """Records of one file by position, in the order asked for, through the offset index (shuffled reads)."""
    where, base = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{base}/{name}.idx") as f:
        index = np.frombuffer(f.read(), dtype=INDEX)
    with where.open_input_file(f"{base}/{name}.rec") as f:
        out = []
        for p in positions:
            f.seek(int(index["offset"][p]))
            out.append(unframe(f.read))
        return out


def token_records(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """What read_records gives for docs, written to a folder of its own, which goes when it has been read back."""
    folder = f"{shared_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    with tables() as made:
        out = stored(read_records(write_records(docs, tokenizer_path, folder), folder), "read")
        made.release(out)
    removed(docs.sparkSession, folder)
    return out
