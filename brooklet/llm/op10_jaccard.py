"""Exact Jaccard metric-space join of word-shingle sets.

Jaccard distance is a metric, but nearly all texts are at distance 1 from any pivot, where the triangle inequality says
nothing; a global pivot table would leave one region that holds everything. So pivots are taken where distances can be
below 1: the universe of shingles is dealt into so many parts that any two sets within the radius agree on a whole part
(their difference is smaller than the number of parts). Sets that agree on a part form a Voronoi region around the least
of them, its pivot; a set lies in the region of each pivot that it may be near, and sets near the edge of a size
ring are replicated into the next ring. A set's sketch has a byte for each part; sketches differ in at most as many bytes
as sets in shingles, so their Hamming distance is a metric that bounds the sets' difference from below. Pairs of a set
and its pivot that the bound allows are verified exactly and link within the radius. A region that then still holds
several components is joined in itself: sets are sorted by their sketch's distance to the pivot, and only those within a
triangle-inequality window of each other are compared; what the sketches allow is verified. Near copies lie in many
regions together; a pair is compared in the largest of them. Regions too large for a task are split by the next round's
parts and pivots; what doesn't get smaller by them, such as thousands of near copies of one text, is joined block by
block. A part that very many sets agree on is told from a sample beforehand and
gets its pivot from there, so its sets needn't meet in one task. Nothing is dropped at any size: the result is the exact
join's classes.

Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import batches
from .common import components, discard, only, stored, tables

U = np.uint64
SIZE = 5
MUL = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


FINAL = (U(30), U(0xBF58476D1CE4E5B9), U(27), U(0x94D049BB133111EB), U(31))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    a, m, b, n, c = FINAL
    x = x ^ (x >> a)
    x *= m
    x ^= x >> b
    x *= n
    x ^= x >> c
    return x


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
LONG = 64


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word of data begins, its 64-bit hash): eight bytes of all words at a time; longer words one by one."""
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    ink = ~WHITE[raw[: len(data)]]
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    first, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=raw, strides=(1,))
    out = size.astype(U) * MUL[0]
    own = np.flatnonzero(size <= LONG)
    for lane in range(0, LONG, 8):
        own = own[size[own] > lane]
        if not len(own):
            break
        out[own] = mixed((out[own] + MUL[1]) ^ (eight[first[own] + lane] & MASK[np.minimum(size[own] - lane, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + size[i]])
    return first, out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; of the whole sequence where there are fewer words;
    empty without words."""
    out = []
    for lo, hi in batches([t or "" for t in texts], most=500):
        data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[lo:hi]]
        begin, word = _word_hashes(b"\n".join(data))
        ends = np.cumsum([len(d) + 1 for d in data])
        at = np.searchsorted(begin, np.concatenate([[0], ends])).tolist()

        def shingled(w, k):
            h = np.full(len(w) - k + 1, U(k))
            for i in range(k):
                h += w[i : len(w) - k + 1 + i] * MUL[i]
            return mixed(h)

        whole = shingled(word, SIZE) if len(word) >= SIZE else word[:0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            k = min(SIZE, b - a)
            out.append(distinct(whole[a : b - SIZE + 1]) if k == SIZE else shingled(word[a:b], k) if k else word[:0])
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


@functools.lru_cache(maxsize=4096)
def ring(j: int, num: int = 4, den: int = 5) -> tuple[int, int, int]:
    """(least size, parts, spare) of ring j for the threshold num/den. Any two linked sets of the ring agree on more than `spare` parts."""
    low, high = _edges(j, num, den)
    most = 2 * high * (den - num) // (den + num)  # of the symmetric difference of two linked sets
    spare = 1
    for _ in range(20):
        parts = most + 1 + spare
        empty = parts * math.exp(-low * num / den / parts)
        want = min(most + 4, math.ceil(empty + 4 * math.sqrt(empty)) + 1)
        if want <= spare:
            break
        spare = want
    return low, most + 1 + spare, spare


def _edges(j: int, num: int, den: int) -> tuple[int, int]:
    """Sizes from the first to the second lie in ring j; edges grow by den/num."""
    edge = [1]
    while len(edge) <= j + 1:
        edge.append(max(edge[-1] + 1, -(-edge[-1] * den // num)))
    return edge[j], edge[j + 1] - 1


@functools.lru_cache(maxsize=100_000)
def rings_of(n: int, num: int = 4, den: int = 5) -> tuple[int, ...]:
    """The ring of size n and, as boundary, those in which a larger partner can lie."""
    out, j = [], 0
    while True:
        low, high = _edges(j, num, den)
        if low > n * den // num:
            return tuple(out)
        if high >= n:
            out.append(j)
        j += 1


def _dealt(s: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles as sorted numbers of this seed, and what each adds to its part's hash."""
    base = np.sort(mixed(s + U((seed * int(MUL[0]) + 1) % 2**64))) if seed else s
    return base, mixed(base ^ MUL[1])


def _parts(base: np.ndarray, weight: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(numbers of the parts that aren't empty, hashes of their shingles, all parts, spare) of a set in ring j; a part is a
    range of numbers, so the sorted set needs no further sort."""
    _, parts, spare = ring(j)
    own = ((base >> U(32)) * U(parts)) >> U(32)
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    return own[first].astype(np.int64), mixed(np.add.reduceat(weight, first)), parts, spare


def signed(s: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's parts in its rings, the ring in the key's low byte; and for each key how many keys of that ring
    the set shares with any set that it links with.

    An empty part gives a key only where more parts are empty than are spare. Linked sets agree on more parts than are
    spare, so they agree on one that isn't empty in both, and on more by as many as are spare beyond the empty ones."""
    keys, needs = [], []
    base, weight = _dealt(s, seed)
    for j in rings_of(len(s)) if len(s) else ():
        own, total, parts, spare = _parts(base, weight, j)
        salt = U((j + 1) << 32) + U(seed + 1) * MUL[2]
        k = [mixed(total + mixed(own.astype(U) + salt))]
        empty = parts - len(own)
        if empty > spare:
            k.append(mixed(mixed(np.setdiff1d(np.arange(parts), own).astype(U) + salt) ^ MUL[3]))
        keys += [(x & ~U(255)) | U(j) for x in k]
        needs += [np.full(len(x), max(1, spare + 1 - empty)) for x in k]
    return (np.concatenate(keys), np.concatenate(needs)) if keys else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))


def signatures(s: np.ndarray, seed: int = 0) -> np.ndarray:
    return signed(s, seed)[0]


def sketch(s: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rings of a set, and for each a byte per part (0 for an empty one)."""
    rings = list(rings_of(len(s)))
    out = []
    base, weight = _dealt(s, 0)
    for j in rings:
        own, total, parts, _ = _parts(base, weight, j)
        row = np.zeros(parts, dtype=np.uint8)
        row[own] = (total >> U(56)).astype(np.uint8)
        out.append(row.tobytes())
    return rings, out


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def _slices(rows, size: int = 500):
    """The batches of rows, cut: what a task holds beside a batch doesn't grow with its rows."""
    only()
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _arrays(column) -> list[np.ndarray]:
    """The lists of a column of array<long>, as views of one buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])


def _sets_of(rows):
    for batch in _slices(rows):
        found = [(len(s), _class(s)) for s in shingle_sets(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["doc_id", "text_key", "n", "cls"])


#: A key is hot with more than this share of all rows: so at most 1 / HOT_SHARE keys are, and any other key's rows are
#: no more than an average task's where there are at most as many tasks. Told from one text in SAMPLE, by its hash, and
#: from HOT_LEAST sets there at least. Which keys are hot changes where rows lie, never what links.
HOT_SHARE, SAMPLE, HOT_LEAST = 1e-5, 64, 16
#: Tasks that a hot key's rows may be dealt to.
SALTS = 1024


class Hot:
    """Hot keys and the pivot of each, any set that has the key."""

    def __init__(self, region: np.ndarray, key: np.ndarray, pivot: np.ndarray):
        ids = self.ids_of(region, key)
        order = np.argsort(ids)
        self.ids, self.pivots = ids[order], pivot[order]

    @staticmethod
    def ids_of(region, key: np.ndarray) -> np.ndarray:
        return mixed(np.asarray(region).astype(U) * MUL[1] + key.astype(U))

    def find(self, region, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are hot, the pivots of those)."""
        if not len(self.ids):
            return np.zeros(len(key), dtype=bool), self.pivots
        ids = self.ids_of(region, key)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        found = self.ids[at] == ids
        return found, self.pivots[at[found]]


def _no_hot() -> Hot:
    return Hot(*(np.zeros(0, dtype=np.int64) for _ in range(3)))


def _hot(keys: DataFrame) -> Hot:
    """Hot keys of a sample's keys ([region,] key, cls)."""
    by = [c for c in ("region", "key") if c in keys.columns]
    sample = stored(keys.select(*by, "cls").distinct(), "sample")
    least = max(HOT_LEAST, HOT_SHARE * sample.count())
    found = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("pivot")).where(F.col("n") >= least).toArrow()
    discard(sample)
    region, key, pivot = (found.column(c).to_numpy() if c in found.column_names else np.zeros(len(found), dtype=np.int64) for c in ("region", "key", "pivot"))
    return Hot(region, key, pivot)


def _met(keys: DataFrame, parts: int) -> DataFrame:
    """keys ([region,] key, cls, need), equal ones side by side in a task; those of a hot key (need < 0) in several tasks."""
    by = [c for c in ("region", "key") if c in keys.columns]
    salt = F.when(F.col("need") < 0, F.pmod("cls", F.lit(SALTS))).otherwise(0)
    return keys.repartition(parts, *by, salt).sortWithinPartitions(*by, "cls")


def _keys_of(hot: Hot, rows):
    """(key, cls, need) of the texts' parts, need negative for a hot key; a copy that this task has seen before adds nothing."""
    seen: set[int] = set()
    out, n = [], 0

    def batch_of():
        key, cls, need = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(need, pa.int32())], names=["key", "cls", "need"])

    for batch in _slices(rows):
        for s in shingle_sets(batch.column(1).to_pylist()):
            c = _class(s)
            if not len(s) or c in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(c)
            k, need = signed(s)
            k = k.view(np.int64)
            out.append((k, np.full(len(k), c, dtype=np.int64), np.where(hot.find(0, k)[0], -need, need)))
            n += len(k)
            if n > 200_000:
                yield batch_of()
                out, n = [], 0
    if n:
        yield batch_of()


def _stars(region: bool, hot: Hot, rows):
    """From rows sorted by (region, key, cls): (region, ring, pivot, member, hits, need) for each set of a key that several
    sets have, its pivot among them; hits counts keys. A hot key's pivot is known; else it is the first set. Memory
    doesn't grow with a key's rows."""
    last = (None, None, 0, 0, 0)  # region, key, pivot, the pivot's need, member
    for batch in rows:
        if not batch.num_rows:
            continue
        r = batch.column(0).to_numpy() if region else np.zeros(batch.num_rows, dtype=np.int64)
        k, c, need = (batch.column(int(region) + i).to_numpy() for i in range(3))
        is_hot, known = (need < 0), None
        if is_hot.any():
            known, need = hot.find(r[is_hot], k[is_hot])[1], np.abs(need)
        new = np.concatenate([[(r[0], k[0]) != last[:2]], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        pivot, its = (np.where(start >= 0, x[np.maximum(start, 0)], y) for x, y in ((c, last[2]), (need, last[3])))
        again = ~new & (c == np.concatenate([[last[4]], c[:-1]]))  # the same set from another task
        further = np.flatnonzero(((c != pivot) | is_hot) & ~again)
        if known is not None:
            pivot[is_hot] = known
        hits: Counter = Counter()
        needs = {}
        ring_of = k[further] & 255
        for x, n in zip(zip(r[further].tolist(), ring_of.tolist(), pivot[further].tolist(), c[further].tolist(), strict=True), need[further].tolist(), strict=True):
            hits[x] += 1
            needs[x] = n
        cold = further[~is_hot[further]]
        first = cold[np.unique(start[cold], return_index=True)[1]]  # one row for each key here; a hot key's pivot has its own
        for x, n in zip(zip(r[first].tolist(), (k[first] & 255).tolist(), pivot[first].tolist(), pivot[first].tolist(), strict=True), its[first].tolist(), strict=True):
            hits[x] += 1
            needs[x] = n
        last = (r[-1], k[-1], pivot[-1], its[-1], c[-1])
        if hits:
            cols = [*zip(*hits, strict=True), hits.values(), needs.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], names=["region", "ring", "pivot", "member", "hits", "need"])


STARS = "region long, ring long, pivot long, member long"


def _likely(keys: DataFrame, region: bool, hot: Hot) -> DataFrame:
    """Stars without members that share too few keys to link with any set, and without regions that keep one set."""
    found = keys.mapInArrow(functools.partial(_stars, region, hot), STARS + ", hits long, need long")
    hits = stored(found.groupBy("region", "ring", "pivot", "member").agg(F.sum("hits").alias("hits"), F.max("need").alias("need")), "hits")
    enough = hits.groupBy("region", "ring", "member").agg(F.sum("hits").alias("hits"), F.max("need").alias("need")).where("hits >= need")
    kept = stored(hits.drop("hits", "need").join(enough.select("region", "ring", "member"), ["region", "ring", "member"], "left_semi"), "likely")
    several = kept.groupBy("region", "ring", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region", "ring", "pivot")
    out = kept.where("member != pivot").join(several, ["region", "ring", "pivot"], "left_semi")
    out = stored(out.select("region", "ring", "pivot", "member"), "stars")
    for table in (hits, kept):
        discard(table)
    return out


def _measured(rows):
    """Adds ham, the distance of the two sketches in the ring, and near: whether it allows a link."""
    for batch in _slices(rows):
        get = {k: batch.column(k).to_pylist() for k in ("ring", "nm", "np", "rm", "rp", "km", "kp")}
        ham, near = [], []
        for j, nm, n_p, rm, rp, km, kp in zip(*get.values(), strict=True):
            a, b = np.frombuffer(km[rm.index(j)], dtype=np.uint8), np.frombuffer(kp[rp.index(j)], dtype=np.uint8)
            ham.append(int(np.count_nonzero(a != b)))
            near.append(ham[-1] <= (nm + n_p) // 9)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("region", "ring", "pivot", "member")), pa.array(ham, pa.int64()), pa.array(near, pa.bool_())], names=["region", "ring", "pivot", "member", "ham", "near"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with common (size of the intersection), np and nm (sizes)."""
    one = sets.select(F.col("cls").alias("member"), F.col("s").alias("sm"))
    two = sets.select(F.col("cls").alias("pivot"), F.col("s").alias("sp"))
    both = pairs.join(one, "member").join(two, "pivot")
    return both.select(*pairs.columns, F.size(F.array_intersect("sp", "sm")).cast("long").alias("common"), F.size("sp").cast("long").alias("np"), F.size("sm").cast("long").alias("nm"))


LINKED = "100 * common >= 80 * (np + nm - common)"

def _open(comp: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Positions of which each open pair holds at least one. A pair is open where its components differ and not both sets
    lie in the region that settles this region's copies of its pairs."""
    _, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    few = at != np.argmax(count)
    return np.flatnonzero(few if np.count_nonzero(few) <= np.count_nonzero(~settled) else ~settled)


def _window(key, table: pa.Table) -> pa.Table:
    """Sets of one region that may link with one of another component: a row for each, however many partners it has.

    Sets are sorted by their distance to the pivot. By the triangle inequality a partner's distance differs by at most
    the most that two linked sets of these sizes can.
    """
    order = np.argsort(table.column("ham").to_numpy(), kind="stable")
    cls, comp, ham, n, settled = (table.column(k).to_numpy()[order] for k in ("cls", "component", "ham", "n", "settled"))
    rows = table.column("sketch").to_pylist()
    grid = np.frombuffer(b"".join(rows[i] for i in order), dtype=np.uint8).reshape(len(order), -1)
    most, active = 2 * int(n.max()) // 9, np.zeros(len(order), dtype=bool)
    todo = np.ones(len(order), dtype=bool)  # not compared with all others yet
    for i in _open(comp, settled):
        todo[i] = False
        start, stop = np.searchsorted(ham, ham[i] - most), np.searchsorted(ham, ham[i] + most, side="right")
        pairs = todo[start:stop] & (comp[start:stop] != comp[i])
        if settled[i]:
            pairs &= ~settled[start:stop]
        if active[i]:
            pairs &= ~active[start:stop]
        j = start + np.flatnonzero(pairs)
        if len(j):
            j = j[np.count_nonzero(grid[j] != grid[i], axis=1) <= (n[j] + n[i]) // 9]
            active[j] = True
            active[i] |= len(j) > 0
    own = cls[active]
    return pa.table({"region": pa.array(np.full(len(own), key[0].as_py()), pa.int64()), "cls": pa.array(own, pa.int64()), "component": pa.array(comp[active], pa.int64()), "settled": pa.array(settled[active])})


def _differences(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set, as numbers from 0, the shingles that tell it from those that over half of the sets have."""
    terms, at = np.unique(np.concatenate(sets), return_inverse=True)
    usual = 2 * np.bincount(at, minlength=len(terms)) > len(sets)
    centre, has, out = np.flatnonzero(usual), np.zeros(len(terms), dtype=bool), []
    for own in np.split(at, np.cumsum([len(s) for s in sets])[:-1]):
        has[own] = True
        out.append(np.concatenate([own[~usual[own]], centre[~has[centre]]]))
        has[own] = False
    return out


def _leaf(key, table: pa.Table) -> pa.Table:
    """Links of one region's sets, as a spanning forest: each set against all others through postings of the shingles by
    which they differ from the region's usual ones. Two sets' difference is the sum of theirs less twice what those share,
    whatever is taken as usual; so shingles that nearly all sets have cost nothing."""
    cls, comp, settled = (table.column(k).to_numpy() for k in ("cls", "component", "settled"))
    sets = _arrays(table.column("s"))
    size, own = np.array([len(s) for s in sets]), _differences(sets)
    apart = np.array([len(d) for d in own])
    at = np.concatenate(own)
    posting = np.repeat(np.arange(len(sets)), apart)[np.argsort(at, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(at))])
    label, out = comp.copy(), []
    for i in _open(comp, settled):
        near = [posting[begin[t] : begin[t + 1]] for t in own[i]]
        shared = np.bincount(np.concatenate(near), minlength=len(sets)) if near else 0
        common = (size[i] + size - apart[i] - apart) // 2 + shared
        for j in np.flatnonzero((100 * common >= 80 * (size[i] + size - common)) & (label != label[i])):
            if label[j] != label[i]:
                out.append((int(cls[i]), int(cls[j])))
                label[label == label[j]] = label[i]
    cols = list(zip(*out, strict=True)) if out else [[], []]
    return pa.table({"u": pa.array(cols[0], pa.int64()), "v": pa.array(cols[1], pa.int64())})


def _regions(stars: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (region, ring, cls, component, ham, members, settled) of the regions that hold an open pair.

    Near copies lie in many regions together, one for each pivot of their parts. A region leaves the pairs that both lie
    in its parent to that: the region of most members (then id) that one of its sets lies in, taken for as many sets as
    possible. Parents are larger in that order, so each pair is left in a region at last.
    """
    region = F.xxhash64("region", "ring", "pivot").alias("region")
    both = stored(_with_component(stars.select(region, "ring", F.col("member").alias("cls"), "ham"), comp, "cls", "component"), "regions")
    sizes = stored(both.groupBy("region").agg(F.count(F.lit(1)).alias("members"), (F.min("component") != F.max("component")).alias("several")), "sizes")
    top = both.join(sizes, "region").groupBy("cls").agg(F.max(F.struct("members", "region"))["region"].alias("parent"))
    parents = both.join(sizes.where("several"), "region").join(top, "cls").groupBy("region", "members").agg(F.mode("parent").alias("parent"))
    parents = stored(parents.withColumn("parent", F.expr("nullif(parent, region)")), "parents")
    lies = both.select("region", "cls").unionByName(stars.select(region, F.col("pivot").alias("cls")).distinct())
    lies = lies.select(F.col("region").alias("parent"), "cls", F.lit(True).alias("settled"))
    out = both.join(parents, "region").join(lies, ["parent", "cls"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    out = stored(out.select("region", "ring", "cls", "component", "ham", "members", "settled"), "open")
    return out.join(out.where("not settled").select("region").distinct(), "region", "left_semi")


def _blocks(regions: DataFrame, most_members: int) -> DataFrame:
    """Each region dealt into blocks, and a region for each two of them: any two sets meet in one."""
    n, own = F.ceil(2 * F.col("members") / most_members), F.pmod(F.xxhash64("cls"), F.col("blocks"))
    out = regions.withColumn("blocks", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    out = out.where("own != other").withColumn("region", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
    return out.select(*regions.columns)


def _region_keys(seed: int, hot: Hot, rows):
    for batch in _slices(rows):
        for r, c, s in zip(batch.column("region").to_pylist(), batch.column("cls").to_pylist(), _arrays(batch.column("s")), strict=True):
            k, need = signed(s.view(U), seed)
            k = k.view(np.int64)
            need = np.where(hot.find(np.full(len(k), r), k)[0], -need, need)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r)), pa.array(k), pa.array(np.full(len(k), c)), pa.array(need, pa.int32())], names=["region", "key", "cls", "need"])


def _with_component(df: DataFrame, comp: DataFrame, column: str, name: str) -> DataFrame:
    c = comp.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(c, column, "left").withColumn(name, F.coalesce(name, column))


def class_links(docs: DataFrame, classes: DataFrame, most_members: int = 8_000, broadcast_rows: int = 500_000) -> DataFrame | None:
    """Components (node, component) of the classes (cls, own) of equal sets; None where no two sets can be near. own: id
    and text key of the row whose text stands for the class.

    most_members: sets of a region that one task joins; larger regions go to a next round, and what is larger still then
    is joined block by block.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts, made = _texts(docs), "key long, cls long, need int"
    hot = _hot(texts.where(F.pmod("text_key", F.lit(SAMPLE)) == 0).mapInArrow(functools.partial(_keys_of, _no_hot()), made))
    stars = _likely(_met(texts.mapInArrow(functools.partial(_keys_of, hot), made), parts), False, hot)
    near = stars.select(F.explode(F.array("pivot", "member")).alias("cls")).distinct()
    ids = stored(classes.join(near, "cls").select("cls", F.col("own.doc_id").alias("own_id"), F.col("own.text_key").alias("own_key")), "near")
    n = ids.count()
    if not n:
        return None
    rows = _texts(docs)
    own = rows.join(F.broadcast(ids) if n <= broadcast_rows else ids, rows.doc_id.eqNullSafe(F.col("own_id")) & (rows.text_key == F.col("own_key")))
    own = own.groupBy("cls").agg(F.min("text").alias("text"))  # rows that are equal throughout count once

    def make(rows):
        for batch in _slices(rows):
            sets = shingle_sets(batch.column(1).to_pylist())
            drawn = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([d[0] for d in drawn], pa.list_(pa.int64())), pa.array([d[1] for d in drawn], pa.list_(pa.binary()))],
                names=["cls", "n", "s", "rings", "sketches"],
            )

    sets = stored(own.mapInArrow(make, "cls long, n long, s array<long>, rings array<long>, sketches array<binary>"), "sets")
    comp, seed = None, 1

    def add(links: DataFrame) -> None:
        """Components of what is known, one edge for each node, and new links; nothing to do without new links."""
        nonlocal comp
        links = stored(links, "links")
        if comp is None:
            comp = stored(components(links), "components")
        elif links.limit(1).count():
            known = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comp = stored(components(known.unionByName(links)), "components")

    def link(pairs: DataFrame) -> None:
        add(_verified(pairs, sets).where(LINKED).select(F.col("pivot").alias("u"), F.col("member").alias("v")))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose sets no links connect so far: only these need to be verified."""
        if comp is None:
            return pairs
        return _with_component(_with_component(pairs, comp, "member", "cm"), comp, "pivot", "cp").where("cm != cp").drop("cm", "cp")

    while True:
        one, two = (sets.select(F.col("cls").alias(c), F.col("n").alias(f"n{k}"), F.col("rings").alias(f"r{k}"), F.col("sketches").alias(f"k{k}")) for c, k in (("member", "m"), ("pivot", "p")))
        stars = stored(stars.join(one, "member").join(two, "pivot").mapInArrow(_measured, STARS + ", ham long, near boolean"), "measured")
        maybe = stars.where("near").select("pivot", "member").distinct()
        link(apart(maybe).groupBy("member").agg(F.min("pivot").alias("pivot")))
        link(apart(maybe))
        # Pairs with the pivot are settled. Regions whose other sets still lie in several components are joined in themselves.
        found, is_large = _regions(stars, comp), F.col("members") > most_members
        small, large = found.where(~is_large), found.where(is_large)
        if seed > 1:  # what another seed's parts don't split is alike throughout
            small = small.unionByName(_blocks(large, most_members))
        small = small.join(sets.select("cls", "n", "rings", "sketches"), "cls")
        small = small.select("region", "cls", "component", "settled", "ham", "n", F.element_at("sketches", F.array_position("rings", F.col("ring")).cast("int")).alias("sketch"))
        active = stored(small.groupBy("region").applyInArrow(lambda key, t: _window(key, t), "region long, cls long, component long, settled boolean"), "windows")
        whole = active.join(sets.select("cls", "s"), "cls")
        add(whole.groupBy("region").applyInArrow(lambda key, t: _leaf(key, t), "u long, v long"))
        if seed > 1 or not large.limit(1).count():
            return comp
        again = large.join(sets.select("cls", "s"), "cls").select("region", "cls", "s")
        made = "region long, key long, cls long, need int"
        hot = _hot(again.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0).mapInArrow(functools.partial(_region_keys, seed, _no_hot()), made))
        stars = _likely(_met(again.mapInArrow(functools.partial(_region_keys, seed, hot), made), parts), True, hot)
        seed += 1


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, component_id, group), one per row of docs: text_key is the xxhash64 of the text,
    group a number that the documents of a component share (null without shingles)."""
    with tables() as made:
        rows = stored(_texts(docs).mapInArrow(_sets_of, "doc_id long, text_key long, n long, cls long"), "shingles")
        # The least id stands for a class; classes of null ids alone have one too, so they can be a link between others.
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
        classes = rows.where("n > 0").groupBy("cls").agg(F.min(first).alias("own"))
        comp = class_links(docs, classes)
        made.release(rows, *([comp] if comp is not None else []))
    classes = classes.select("cls", F.col("own.doc_id").alias("least"))
    if comp is not None:
        classes = classes.join(comp, F.col("node") == F.col("cls"), "left").select("cls", "least", F.coalesce("component", "cls").alias("group"))
        low = classes.groupBy("group").agg(F.min("least").alias("component_id"))
        classes = classes.join(low, "group").select("cls", "group", "component_id")
    else:
        classes = classes.select("cls", F.col("cls").alias("group"), F.col("least").alias("component_id"))
    out = rows.where("n > 0").join(classes, "cls").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group")
    return out.unionByName(rows.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group")))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of docs.

    Null or wordless texts have an empty set and their own id as component. Rows with equal ids keep a row each. A null
    id is its own component (null) unless its text links it with a document that has an id; it links others like any.
    An empty table gives no rows; other columns are ignored, whatever their names; texts are shingled whole, however
    long, and a text's memory grows with its words.
    """
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")
