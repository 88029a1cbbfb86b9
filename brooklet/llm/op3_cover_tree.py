"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Unit vectors at cosine c lie at distance sqrt(2 - 2c), so a cosine threshold is a radius. The upper levels of the tree
are made by Spark: cells around a bounded number of centres each, cut again while they are large, then blocks of bounded
size. Each block holds the lower levels: nested nets whose radii halve, down to the single vectors. The traversal starts
with the pair of the root and itself. A pair of nodes is pruned where the centres' distance exceeds the threshold radius
plus both covering radii, taken whole where distance and covering radii together stay below it, and else replaced by the
pairs of its children. Above the blocks the frontier is a table that is joined with the children of its nodes level by
level; within a pair of blocks it is a list of arrays. Links are counted, not listed, so a dense cluster makes no
quadratic output.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, components, discard, stored, tables

#: Children of a cell, and bytes of centres that may be broadcast to find a vector's cell; beyond them cells are cut by hash.
FAN, CENTRE_BYTES = 64, 32 << 20
PART_BITS = 20


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def slack(width: int) -> float:
    """More than the error of a distance computed from a cosine, three times over (largest near cosine 1)."""
    return 4 * math.sqrt(2 * 2.2e-16 * max(1, width)) + 1e-9


def net(x: np.ndarray, radius: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Centres (indexes) of a greedy net, apart by more than radius, and each point's nearest centre (position among them)."""
    least, centres = 1 - radius * radius / 2, []
    for at in range(0, len(x), step):
        own = x[at : at + step]
        left = np.arange(len(own))
        if centres:
            left = left[(own @ x[centres].T).max(1) < least]
        near = own[left] @ own[left].T >= least
        taken = np.zeros(len(left), dtype=bool)
        for i in range(len(left)):
            if not taken[i]:
                centres.append(at + int(left[i]))
                taken |= near[i]
    centres = np.array(centres, dtype=np.int64)
    owner = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), step):
        owner[at : at + step] = (x[at : at + step] @ x[centres].T).argmax(1)
    owner[centres] = np.arange(len(centres))
    return centres, owner


class Tree:
    """Nested levels of nets over unit vectors. order: the points so that each node holds a run of them; a level is
    (first point of each node and the end, centre of each, covering radius of each). The last level is the points.

    Radii halve from the greatest at which two nodes on the sphere can be apart at all to a quarter of the threshold radius."""

    def __init__(self, x: np.ndarray, radius: float):
        n, r, self.levels = len(x), 1.0, []
        while radius + 2 * r >= 2:
            r /= 2
        order, starts = np.arange(n), np.array([0, n])
        ranges = []
        while True:
            label, centre = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            sizes = np.diff(starts)
            centre[starts[:-1][sizes == 1]] = True
            for g in np.flatnonzero(sizes > 1):
                lo, hi = starts[g], starts[g + 1]
                c, own = net(x[order[lo:hi]], r)
                label[lo:hi], centre[lo + c] = own, True
            group = np.repeat(np.arange(len(sizes)), sizes)
            move = np.lexsort((label, group))
            order, centre, group, label = order[move], centre[move], group[move], label[move]
            starts = np.concatenate([np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(label) != 0)])), [n]])
            ranges.append((starts, order[centre]))
            if r <= radius / 4 or len(starts) - 1 == n:
                break
            r /= 2
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.order, self.x = order, x[order]
        for starts, centre in ranges:
            at = place[centre]
            own = np.repeat(at, np.diff(starts))
            cover = np.maximum.reduceat(distance(np.einsum("ij,ij->i", self.x, self.x[own])), starts[:-1])
            cover[np.diff(starts) == 1] = 0
            self.levels.append((starts, at, cover))
        if len(self.levels[-1][1]) < n:
            self.levels.append((np.arange(n + 1), np.arange(n), np.zeros(n)))

    def packed(self) -> bytes:
        return pickle.dumps([(s.astype("<i4"), c.astype("<i4"), r.astype("<f8") if r.any() else len(r)) for s, c, r in self.levels])

    @classmethod
    def unpacked(cls, x: np.ndarray, data: bytes) -> Tree:
        """The tree of points that are in its order already."""
        own = cls.__new__(cls)
        own.order, own.x = np.arange(len(x)), x
        own.levels = [(s.astype(np.int64), c.astype(np.int64), np.zeros(r) if isinstance(r, int) else r) for s, c, r in pickle.loads(data)]
        return own


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the runs [first, last)."""
    n = last - first
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def dual(a: Tree, b: Tree, least: float, chunk: int = 2_000_000):
    """Descends the live pairs of nodes. Yields (first and last point of a's nodes, of b's, centres in a, in b) for pairs of
    nodes that link whole, single points among them, and as last item the number of node pairs that were compared."""
    radius, spare, work = math.sqrt(2 - 2 * least), slack(a.x.shape[1]), 0
    depth = max(len(a.levels), len(b.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    todo = [(np.arange(len(level(a, 0)[1])), np.arange(len(level(b, 0)[1])))]
    for k in range(depth):
        (sa, ca, ra), (sb, cb, rb) = level(a, k), level(b, k)
        one_a, one_b = np.diff(sa) == 1, np.diff(sb) == 1
        below = k + 1 < depth
        if below:
            kids_a, kids_b = (np.searchsorted(level(t, k + 1)[0], s) for t, s in ((a, sa), (b, sb)))
        after = []
        for rows, cols in todo:
            for own_cols in (cols[one_b[cols]], cols[~one_b[cols]]):
                if not len(own_cols):
                    continue
                other, reach = b.x[cb[own_cols]], rb[own_cols].max()
                for own_rows in (rows[one_a[rows]], rows[~one_a[rows]]):
                    step = max(1, chunk // len(own_cols))
                    for at in range(0, len(own_rows), step):
                        r = own_rows[at : at + step]
                        cosine = a.x[ca[r]] @ other.T
                        work += cosine.size
                        far = radius + ra[r] + reach + spare
                        i, j = np.nonzero(cosine >= np.where(far >= 2, -2, 1 - far * far / 2)[:, None])
                        if not len(i):
                            continue
                        c, i, j = cosine[i, j], r[i], own_cols[j]
                        single = one_a[i] & one_b[j]
                        d, cover = distance(c), ra[i] + rb[j]
                        whole = np.where(single, c >= least, d + cover < radius - spare)
                        if whole.any():
                            u, v = i[whole], j[whole]
                            yield sa[u], sa[u + 1], sb[v], sb[v + 1], ca[u], cb[v]
                        live = ~single & ~whole & (d <= radius + cover + spare)
                        if below and live.any():
                            after.append((i[live], j[live]))
        todo = []
        if after:
            i, j = (np.concatenate(z) for z in zip(*after, strict=True))
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                todo.append((np.arange(kids_a[i[lo]], kids_a[i[lo] + 1]), _runs(kids_b[j[lo:hi]], kids_b[j[lo:hi] + 1])))
    yield work


def _roots(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each vertex's component, by minima along edges with pointer jumping."""
    label = np.arange(n)
    if not edges:
        return label
    u, v = (np.concatenate(e) for e in zip(*edges, strict=True))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def joined(a: Tree, b: Tree, same: bool, mass_a: np.ndarray, mass_b: np.ndarray, least: float):
    """(links of a's points, links of b's points, component label over a's then b's points, node pairs compared)."""
    na, nb = len(a.x), len(b.x)
    sum_a, sum_b = (np.concatenate([[0.0], np.cumsum(m)]) for m in (mass_a, mass_b))
    count_a, count_b = np.zeros(na + 1), np.zeros(nb + 1)  # differences from point to point
    edges, work = [], 0
    for found in dual(a, b, least):
        if isinstance(found, int):
            work = found
            break
        a0, a1, b0, b1, u, v = found
        for count, first, last, more in ((count_a, a0, a1, sum_b[b1] - sum_b[b0]), (count_b, b0, b1, sum_a[a1] - sum_a[a0])):
            np.add.at(count, first, more)
            np.add.at(count, last, -more)
        edges.append((u, na + v))
        for first, last, centre, base in ((a0, a1, u, 0), (b0, b1, v, na)):
            big = np.unique(np.flatnonzero(last - first > 1))
            if len(big):  # all points of a node that links whole are linked through the other node
                _, pick = np.unique(first[big], return_index=True)
                big = big[pick]
                edges.append((base + _runs(first[big], last[big]), base + np.repeat(centre[big], last[big] - first[big])))
    if same:
        edges.append((np.arange(na), na + np.arange(na)))
    return np.cumsum(count_a)[:-1], np.cumsum(count_b)[:-1], _roots(na + nb, edges), work


def _units(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(vectors: DataFrame, kind: str, width: int, block: int) -> tuple[DataFrame, int]:
    """vectors (rep, copies, data) with their cell, and the number of levels above it: a cell is its parent's number
    times FAN plus the number of its centre. Centres are drawn from the vectors of large cells by the hash of rep."""
    cells, levels = vectors.withColumn("cell", F.lit(0).cast("long")), 0
    while levels < 6:
        sizes = cells.groupBy("cell").count().where(F.col("count") > block)
        most = CENTRE_BYTES // (8 * width * FAN)
        large = {r.cell: r["count"] for r in sizes.limit(most + 1).collect()}
        if not large or len(large) > most:
            break
        share = F.create_map(*[F.lit(x) for c, n in large.items() for x in (c, 4.0 * min(FAN, -(-n // block)) / n)])[F.col("cell")]
        drawn = cells.where(F.pmod(F.xxhash64("rep", F.lit(levels)), F.lit(1 << 30)) < share * (1 << 30))

        def pick(key, t):
            x = _units(t.column("data").to_pylist(), kind)
            c = net(x, 0.5)[0][: min(FAN, -(-large[key[0].as_py()] // block))]
            return pa.table({"cell": [key[0]], "centres": [x[c].tobytes()]})

        centres = {r.cell: np.frombuffer(r.centres).reshape(-1, width) for r in drawn.groupBy("cell").applyInArrow(pick, "cell long, centres binary").collect()}
        if all(len(c) < 2 for c in centres.values()):
            break
        sent = vectors.sparkSession.sparkContext.broadcast(centres)

        def assign(rows, sent=sent):
            for batch in rows:
                if not batch.num_rows:
                    continue
                cell = batch.column("cell").to_numpy()
                new = cell * FAN
                known = np.flatnonzero(np.isin(cell, list(sent.value)))
                if len(known):
                    x = _units(batch.column("data").take(pa.array(known)).to_pylist(), kind)
                    for c in np.unique(cell[known]):
                        own = cell[known] == c
                        new[known[own]] += (x[own] @ sent.value[c].T).argmax(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("rep", "copies", "data")), pa.array(new)], names=["rep", "copies", "data", "cell"])

        before = cells
        cells = stored(cells.mapInArrow(assign, "rep long, copies long, data binary, cell long"), "cells")
        if levels:
            discard(before)
        levels += 1
    return cells, levels


def _heads(rows: DataFrame, width: int) -> DataFrame:
    """Children (node, centre, cover) packed by parent: (parent, nodes, centres, covers), with the parent's own centre and a bound of its cover."""

    def pack(key, t):
        x = np.frombuffer(b"".join(t.column("centre").to_pylist())).reshape(-1, width)
        middle = x.mean(0)
        middle /= np.linalg.norm(middle) or 1.0
        cover = t.column("cover").to_numpy()
        bound = float((distance(x @ middle) + cover).max()) + slack(width)
        return pa.table({"node": [key[0]], "nodes": [t.column("node").to_pylist()], "centres": [x.tobytes()], "covers": [cover.tolist()], "centre": [middle.tobytes()], "cover": [bound]})

    return stored(rows.groupBy("parent").applyInArrow(pack, "node long, nodes array<long>, centres binary, covers array<double>, centre binary, cover double"), "heads")


def _links(vectors: DataFrame, kind: str, width: int, least: float, block: int) -> DataFrame:
    """vectors (rep, copies, data), all of one width: rows (rep, links, root) of each pair of blocks for vectors with a link there."""
    spark, radius, spare = vectors.sparkSession, math.sqrt(2 - 2 * least), slack(width)
    cells, levels = _cells(vectors, kind, width, block)
    cuts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("cuts")).where("cuts > 1")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("cuts", F.lit(1)))
    dealt = cells.join(cuts, "cell", "left").select("rep", "copies", "data", (F.shiftleft("cell", PART_BITS) + part).alias("block"))

    def pack(key, t):
        data = t.column("data").to_pylist()
        x = _units(data, kind)
        tree = Tree(x, radius)
        centre = x.mean(0)
        centre /= np.linalg.norm(centre) or 1.0
        reps, copies = (t.column(k).to_numpy()[tree.order].astype("<i8").tobytes() for k in ("rep", "copies"))
        cover = float(distance(x @ centre).max()) + spare
        return pa.table({"node": [key[0]], "centre": [centre.tobytes()], "cover": [cover], "reps": [reps], "copies": [copies], "data": [b"".join(data[i] for i in tree.order.tolist())], "tree": [tree.packed()]})

    blocks = stored(dealt.groupBy("block").applyInArrow(pack, "node long, centre binary, cover double, reps binary, copies binary, data binary, tree binary"), "blocks")
    heads = [_heads(blocks.select(F.shiftright("node", PART_BITS).alias("parent"), "node", "centre", "cover"), width)]
    for _ in range(levels):
        heads.append(_heads(heads[-1].select(F.floor(F.col("node") / FAN).alias("parent"), "node", "centre", "cover"), width))

    def descend(rows):
        for batch in rows:
            for r in range(batch.num_rows):
                get = {k: batch.column(k)[r].as_py() for k in batch.schema.names}
                xa, xb = (np.frombuffer(get[f"centres_{s}"]).reshape(-1, width) for s in "ab")
                live = distance(xa @ xb.T) <= radius + np.array(get["covers_a"])[:, None] + np.array(get["covers_b"])[None, :] + spare
                if get["a"] == get["b"]:
                    live = np.triu(live)
                i, j = np.nonzero(live)
                na, nb = np.array(get["nodes_a"], dtype=np.int64), np.array(get["nodes_b"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(na[i]), pa.array(nb[j])], names=["a", "b"])

    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for table in reversed(heads):
        side = [table.select(F.col("node").alias(s), *(F.col(k).alias(f"{k}_{s}") for k in ("nodes", "centres", "covers"))) for s in "ab"]
        with arrow_rows(spark, 64):
            pairs = stored(pairs.join(side[0], "a").join(side[1], "b").mapInArrow(descend, "a long, b long"), "frontier")

    def run(key, t):
        order = np.argsort(t.column("node").to_numpy() != key[0].as_py(), kind="stable").tolist()
        column = {k: t.column(k).take(order).to_pylist() for k in ("reps", "copies", "data", "tree")}
        ids = [np.frombuffer(v, dtype="<i8") for v in column["reps"]]
        mass = [np.frombuffer(v, dtype="<i8").astype(float) for v in column["copies"]]
        size = np.dtype(kind).itemsize * width
        trees = [Tree.unpacked(_units([d[i : i + size] for i in range(0, len(d), size)], kind), p) for d, p in zip(column["data"], column["tree"], strict=True)]
        if same := len(trees) == 1:
            links, _, label, _ = joined(trees[0], trees[0], True, mass[0], mass[0], least)
            rep, links, label = ids[0], links - 1, label[: len(ids[0])]  # a vector is no link of its own
        else:
            la, lb, label, _ = joined(*trees, same, *mass, least)
            rep, links = np.concatenate(ids), np.concatenate([la, lb])
        links, root = np.rint(links).astype(np.int64), rep[label]
        some = (links > 0) | (root != rep)
        return pa.table({"rep": rep[some], "links": links[some], "root": root[some]})

    sides = pairs.withColumn("node", F.explode(F.array_distinct(F.array("a", "b")))).join(blocks.drop("centre", "cover"), "node")
    return stored(sides.groupBy("a", "b").applyInArrow(run, "rep long, links long, root long"), "found")


def threshold_links(vectors: DataFrame, least: float = 0.95, block: int = 8192) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of vectors (vec_id, embedding; other columns are ignored).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths don't link. Equal vectors link with each other (their cosine is 1); they are joined as one with a count, so
    a vector that a third of all rows hold costs no more than another. Rows with equal ids are rows of their own. A null
    id has a null component, unless its vector links with one that has an id, and kept false. An empty table gives no
    rows. Longer vectors need more memory a block (block times their length), nothing else.

    Gathered on the driver and broadcast: centres of large cells, at most CENTRE_BYTES.
    """
    wide = not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f8" if wide else "<f4"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'double' if wide else 'float'}>").alias("embedding"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ok = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda e: e != 0), F.lit(False))
    alone = own.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    reps = own.where(ok).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    found = None
    for r in reps.select(F.size("embedding").alias("length")).distinct().orderBy("length").collect():

        def as_bytes(rows, kind=kind):
            for batch in rows:
                data = [np.array(v, dtype=kind).tobytes() for v in batch.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array(data, pa.binary())], names=["rep", "copies", "data"])

        with tables() as made:
            some = reps.where(F.size("embedding") == r.length).select("rep", "copies", "embedding")
            one = _links(some.mapInArrow(as_bytes, "rep long, copies long, data binary"), kind, r.length, least, block)
            made.release(one)
        found = one if found is None else found.unionByName(one)
    if found is None:
        out = alone
    else:
        links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
        comp = components(found.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")), "vectors")
        least_id = reps.join(comp, F.col("node") == F.col("rep"), "left").select("rep", "first", F.coalesce("component", "rep").alias("component"))
        low = least_id.groupBy("component").agg(F.min("first").alias("low"))
        table = stored(least_id.join(low, "component").join(links, "rep", "left").select("rep", "n_links", "low"), "table")
        named = reps.join(table, "rep").select("embedding", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), "low")
        # Rows of a very common vector meet in one key here; the join's other side has one row for it, so it can be split.
        linked = own.where(ok).join(named, "embedding").select("vec_id", "n_links", F.col("low").alias("component_id"))
        out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
