"""Toxicity: Levenshtein automata run over a lexicon trie find misspelled terms, windows of context part quotation from abuse.

The lexicon (whole words and word beginnings) and the weights of a small logistic model are learned from a bounded
sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import functools
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, held_out, only, stored

EDGES = "\"'`“”„«»‘’()[]{}<>.,;:!?…%&*#$-_/\\|~^+="
QUOTES = "\"“”„«»"
#: Words of reported speech in four languages that mark a quotation within the window.
REPORTS = frozenset("said says quote quoted wrote called dit écrit cité sagte schrieb zitat dijo escribió cita".split())
WINDOW = 6


class Trie:
    """Terms: plain words, and beginnings marked with a final `*` that any word may continue."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if t.endswith("*") else ""] = t

    def match(self, word: str, most: int) -> tuple[str, int] | None:
        """Best (term, edits) for word within `most` edits; fewest edits, then the longest and first term.

        The automaton's states are bit masks over positions of word, one for each number of edits: bit p is set where
        p letters are read. Branches of the trie without a live state end.
        """
        n, masks = len(word), {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full, end, best = (1 << (n + 1)) - 1, 1 << n, None
        start = [1]
        for _ in range(most):
            start.append((start[-1] | start[-1] << 1) & full)  # letters of the word that the term lacks
        stack = [(self.root, start)]
        while stack:
            node, state = stack.pop()
            for mark, term in ((m, node[m]) for m in ("", "*") if m in node):
                for e, s in enumerate(state):
                    if e and len(term) - len(mark) < 5:
                        break  # short terms are matched as they are
                    if s and (s & end if mark == "" else e == 0 or s & ~1):
                        key = (e, -len(term), term)
                        if best is None or key < best:
                            best = key
                        break
            for c, child in node.items():
                if len(c) != 1 or c == "*" or isinstance(child, str):
                    continue
                hit = masks.get(c, 0)
                new, live = [], 0
                for e, s in enumerate(state):
                    t = (s & hit) << 1
                    if e:
                        t |= state[e - 1] | state[e - 1] << 1 | new[-1] << 1  # term letter extra, replaced, word letter extra
                    t &= full
                    new.append(t)
                    live |= t
                if live and (best is None or any(new[: best[0] + 1])):
                    stack.append((child, new))
        return None if best is None else (best[2], best[0])


def allowed(word: str) -> int:
    """Edits that a word of this length may have."""
    return 0 if len(word) < 5 else 1


class Scorer:
    """Features and scores of whole texts; most_bytes bounds the words kept."""

    def __init__(self, terms: list[str], weights: np.ndarray | None = None, most_bytes: int = 64 << 20):
        self.trie, self.weights, self.words = Trie(terms), weights, Cache(most_bytes)
        bare = [t.rstrip("*") for t in terms]
        self.heads, self.inner, self.least = {t[:2] for t in bare}, {t[2:5] for t in bare}, min(map(len, bare), default=0)

    def forget(self) -> None:
        self.words.clear()

    def look(self, raw: str) -> tuple[str, int] | bool:
        word = raw.strip(EDGES)
        if len(word) < self.least - 1 or not self.least:
            return False
        # One edit leaves the term's first two letters or, one place off at most, the three after them as they are.
        if word[:2] not in self.heads and word[2:5] not in self.inner and word[1:4] not in self.inner and word[3:6] not in self.inner:
            return False
        return self.trie.match(word, allowed(word)) or False

    def hits(self, text: str) -> list[tuple[int, str, int, bool]]:
        """(word position, term, edits, quoted) of all words that match a term."""
        raw = text.lower().split()
        found = list(map(self.words.get, raw))
        if None in found:
            new = {w: self.words.keep(w, self.look(w)) for w in {w for w, v in zip(raw, found, strict=True) if v is None}}
            found = [new[w] if v is None else v for w, v in zip(raw, found, strict=True)]
        out = []
        for i, hit in enumerate(found):
            if hit:
                near = raw[max(0, i - WINDOW) : i + WINDOW + 1]
                before, after = " ".join(raw[max(0, i - WINDOW) : i]) + raw[i][:1], raw[i][-1:] + " ".join(raw[i + 1 : i + WINDOW + 1])
                inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
                out.append((i, *hit, inside or any(w.strip(EDGES) in REPORTS for w in near)))
        return out

    def features(self, text: str) -> list[float]:
        exact = fuzzy = quoted = 0
        for _, _, edits, quote in self.hits(text):
            if quote:
                quoted += 1
            elif edits:
                fuzzy += 1
            else:
                exact += 1
        n = np.log1p
        return [1.0, float(exact > 0), n(exact), float(fuzzy > 0), n(fuzzy), float(quoted > 0), n(quoted)]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-float(np.dot(self.weights, self.features(text))))))


def _logistic(x: np.ndarray, y: np.ndarray, k: np.ndarray, rows: float, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression of cells (x, y) that count k times each, by Newton steps (the intercept isn't shrunk).

    The counts are scaled to sum to `rows`, so the ridge weighs the same whatever number of rows they stand for.
    """
    k = k * (rows / k.sum())
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (k * (y - p)) - pen * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms_of(text: str) -> set[str]:
    out = set()
    for w in {x.strip(EDGES) for x in text.lower().split()}:
        if len(w) >= 4 and w[:4].isalpha():
            out.add(w)
            out.update(w[:k] + "*" for k in range(4, min(8, len(w) + 1)))
    return out


def choose_terms(rows: list[tuple[str, int, int]], positives: int, negatives: int, least: int = 5, ratio: float = 40.0) -> list[str]:
    """Terms of (term, positive documents, negative documents) that speak for label 1: at least `least` positive
    documents and a smoothed rate `ratio` times that of label 0. A beginning is kept only where it covers clearly more
    than one whole word; a longer beginning or word is dropped where a kept shorter one covers it."""
    good = {t: (p, n) for t, p, n in rows if p >= least and (p / max(1, positives)) >= ratio * ((n + 0.5) / max(1, negatives))}
    words = {t: v for t, v in good.items() if not t.endswith("*")}
    kept: list[str] = []
    for t in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = t[:-1]
        if any(stem.startswith(k[:-1]) for k in kept):
            continue
        whole = max((v[0] for w, v in words.items() if w.startswith(stem)), default=0)
        if good[t][0] > 1.5 * whole:
            kept.append(t)
    kept += [w for w in sorted(words) if not any(w.startswith(k[:-1]) for k in kept)]
    return sorted(kept, key=lambda t: (-good[t][0], t))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> bytes:
    """Terms and weights from text and labels.toxic of rows that aren't held out.

    At most `sample` documents with a label (least hashes of the id; half of them of label 1 at most, as far as there
    are), with whole texts; they are stored once and read by each pass. Null labels, texts and ids are left out; a
    document labelled both ways counts as its greatest label; of rows with equal ids the text with the least hash counts.
    Without a labelled text every score is low. Other columns are ignored, whatever their names.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [own.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
    pick = F.broadcast(picks[0].unionByName(picks[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(pick, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = stored(texts.select("text", "toxic"), "labelled")

    def count(rows):
        total: dict[str, list[int]] = {}
        docs_ = [0, 0]
        for batch in rows:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs_[toxic] += 1
                for t in _terms_of(text):
                    total.setdefault(t, [0, 0])[toxic] += 1
        total[""] = docs_
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total)), "neg": pa.array([v[0] for v in total.values()], pa.int64()), "pos": pa.array([v[1] for v in total.values()], pa.int64())})

    sums = texts.mapInArrow(count, "term string, neg long, pos long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = sums.where("term = '' or pos >= 5 and pos > 2 * neg").collect()
    docs_ = next(((r.pos, r.neg) for r in sums if r.term == ""), (0, 0))
    terms = choose_terms([(r.term, r.pos, r.neg) for r in sums if r.term], *docs_)
    stems, whole = tuple(t[:-1] for t in terms if t.endswith("*")), {t for t in terms if not t.endswith("*")}

    def contexts(rows):
        # A term that only copies of one text hold has few neighbourhoods and says nothing about its label.
        seen = set()
        for batch in rows:
            for text in batch.column(0).to_pylist():
                w = [x.strip(EDGES) for x in text.lower().split()]
                for i, x in enumerate(w):
                    if x in whole or x.startswith(stems):
                        near = zlib.crc32(" ".join(w[max(0, i - 1) : i] + w[i + 1 : i + 2]).encode())
                        seen.update((t, near) for t in ({x} & whole or [s + "*" for s in stems if x.startswith(s)]))
        yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in seen], pa.string()), "near": pa.array([n for _, n in seen], pa.int64())})

    spread = texts.where("toxic = 1").mapInArrow(contexts, "term string, near long").distinct().groupBy("term").count()
    wide = {r.term for r in spread.where(F.col("count") >= 8).collect()}
    terms = [t for t in terms if t in wide]

    def feature(rows):
        own_ = Scorer(terms)
        for batch in rows:
            x = np.array([own_.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(7)] + [batch.column(1)], names=[*(f"f{i}" for i in range(7)), "toxic"])

    names = [f"f{i}" for i in range(7)]
    grid = texts.mapInArrow(feature, ", ".join(f"{n} double" for n in names) + ", toxic int").groupBy(*names, "toxic").count().orderBy(*names, "toxic").toPandas()
    x, y, n = grid[names].to_numpy(float), grid["toxic"].to_numpy(float), grid["count"].to_numpy(int)
    # The sample holds label 1 in full and label 0 in part, so rows of label 0 count by the share that was taken.
    if not len(y):
        return pickle.dumps((terms, np.array([-4.0, 4, 0, 0, 0, 0, 0])))
    share = own.groupBy("toxic").count().collect()
    there = {r.toxic: r["count"] for r in share}
    weight = {v: max(1.0, there.get(v, 1) / max(1, min(sample // 2, there.get(v, 1)))) for v in (0, 1)}
    k = np.array([weight[int(v)] for v in y]) * n
    return pickle.dumps((terms, _logistic(x, y, k, n.sum())))


@functools.lru_cache(maxsize=1)
def _scorer(key: int, model: bytes) -> Scorer:
    return Scorer(*pickle.loads(model))


def score(docs: DataFrame, model: bytes, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of docs. No shuffle.

    Null text is empty, and the empty text has a score too; null and repeated ids keep a row each; an empty table gives
    no rows; texts are scored whole, however long; other columns are ignored, whatever their names.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), zlib.crc32(model)

    def run(rows):
        own = only(_scorer(key, sent.value))
        for batch in rows:
            got = [own.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(g >= threshold) for g in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
