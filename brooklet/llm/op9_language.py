"""Language of mixed texts: script ranges narrow the candidates, a Viterbi pass over per-word scores with a switching
penalty labels spans.

A word's score for a language is the log-likelihood of its character n-grams (hashed) in the training texts of that
language. Model and training sample are bounded; every text is labelled whole.
"""

from __future__ import annotations

import functools
import pickle
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import batches
from .common import held_out, only, stored

#: First and last code point of scripts.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF))
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16


def script_of(word: str) -> int:
    """Index of the script that the word's first letter lies in; len(SCRIPTS) for any other."""
    c = ord(word[0])
    return next((i for i, (_, a, b) in enumerate(SCRIPTS) if a <= c <= b), len(SCRIPTS))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 4-grams of the padded words, and where each word's begin."""
    text = "".join(f"\x02{w}\x03\0\0" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    at = np.cumsum([0] + [len(w) + 4 for w in words[:-1]]) if words else np.zeros(0, dtype=np.int64)
    h, out, inside = c.copy(), [], c != 0
    ok = inside
    for n in range(1, 5):
        if n > 1:
            ok = ok[:-1] & inside[n - 1 :]  # no n-gram reaches into the next word
        key = ((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(20)) % np.uint64(BUCKETS)
        out.append(np.where(np.pad(ok, (0, n - 1)), np.pad(key, (0, len(c) - len(key))), np.uint64(BUCKETS)))
        h = h[:-1] * np.uint64(1_000_003) + c[n:]
    return np.stack(out, axis=1).astype(np.int64), at


def counted(words: dict[str, int]) -> np.ndarray:
    """n-gram counts of {word: occurrences}; an occurrence counts as 1 + log of its number, so frequent words don't rule."""
    names = list(words)
    g, at = grams(names)
    weight = np.repeat(1 + np.log(list(words.values())), [len(w) + 4 for w in names])
    return np.bincount(g.ravel(), np.repeat(weight, 4), minlength=BUCKETS + 1)[:BUCKETS]


def train(docs: DataFrame, per_language: int = 400) -> bytes:
    """Model from text and lang of rows that aren't held out; nulls are left out.

    Fitted on at most per_language whole documents of each language, those with the least hashes of the id; of rows with
    equal ids the text with the least hash counts. All languages are learned; counts are summed on the executors, and the
    driver gets a table of fixed size (256 KB) for each language. An empty table gives a model that knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out())
    number = stored(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")), "languages")
    # Hashes below a bound that per_language ids of a language reach (but for one time in a billion); so the ranking sees
    # few rows of each language, however many it has. The table of languages is stored so that Spark knows its size, and
    # sends it to the rows instead of dealing them by language while it is small.
    share = 1.15 * (per_language + 6 * per_language**0.5 + 30) / F.col("ids")
    low = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(number, "lang")
    low = low.where(F.col("doc_id").isNotNull() & (F.col("h").cast("double") <= share * 2.0**64 - 2.0**63)).select("doc_id", "lang", "h").distinct()
    pick = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language)
    pick = stored(pick.select("doc_id", "lang"), "picked")
    if pick.isEmpty():
        return pickle.dumps(([], np.zeros((BUCKETS + 1, 0), dtype=np.float32), np.zeros((len(SCRIPTS) + 1, 0), dtype=bool)))

    def count(batches_):
        total: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches_:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words: dict[str, int] = {}
                for w in LETTERS.findall((text or "").lower()):
                    words[w] = words.get(w, 0) + 1
                if words:
                    total[lang] = total.get(lang, 0) + counted(words)
                    seen = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1))
                    for w, n in words.items():
                        seen[script_of(w)] += n
        for lang in total:
            keys = np.flatnonzero(total[lang])
            k = np.concatenate([keys, BUCKETS + 1 + np.arange(len(SCRIPTS) + 1)])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k)), "k": pa.array(k), "n": pa.array(np.concatenate([total[lang][keys], scripts[lang]]))})

    sample = rows.join(pick, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("lang", "text")
    sums = sample.mapInArrow(count, "lang string, k long, n double").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(sums["lang"]))
    col = {name: i for i, name in enumerate(names)}
    table, scripts = np.zeros((BUCKETS, len(names))), np.zeros((len(SCRIPTS) + 1, len(names)))
    for lang, k, n in zip(sums["lang"], sums["k"], sums["n"], strict=True):
        if k < BUCKETS:
            table[k, col[lang]] = n
        else:
            scripts[k - BUCKETS - 1, col[lang]] = n
    logp = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * BUCKETS)
    logp = np.vstack([logp, np.zeros(len(names))]).astype(np.float32)
    return pickle.dumps((names, logp, scripts > 0.01 * scripts.sum(0)))


class Labeller:
    """Labels whole texts; most_bytes bounds the words kept between texts."""

    def __init__(self, model: bytes, penalty: float = 8.0, most_bytes: int = 32 << 20):
        self.names, self.logp, self.scripts = pickle.loads(model)
        self.penalty, self.most_bytes, self.floor = penalty, most_bytes, -12.0
        self.excluded = -1000 - 2 * penalty  # below what two switches cost: a language that lacks a word's script never gets it
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.used = 0
        self.table, self.weight, self.n = np.zeros((1024, len(self.names)), dtype=np.float32), np.zeros(1024), 0

    forget = reset

    def scores(self, cores: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language; a bounded number of n-grams at a time, however long a word is."""
        g, at = grams(cores)
        out = np.zeros((len(cores), len(self.names)), dtype=np.float32)
        owner = np.repeat(np.arange(len(cores)), np.diff(np.append(at, len(g))))
        step = max(64, 2_000_000 // max(1, len(self.names)))
        for lo in range(0, len(g), step):
            part, own = g[lo : lo + step], owner[lo : lo + step]
            first = np.maximum(at[own[0] : own[-1] + 1], lo) - lo
            out[own[0] : own[-1] + 1] += np.add.reduceat(self.logp[part].sum(1), first, axis=0)
        return out

    def learn(self, words: list[str]) -> None:
        cores = ["".join(LETTERS.findall(w)) for w in words]
        lettered = [(w, c) for w, c in zip(words, cores, strict=True) if c]
        for w, c in zip(words, cores, strict=True):
            self.used += sys.getsizeof(w) + 120 + (4 * len(self.names) + 8 if c else 0)
            if not c:
                self.rows[w] = -1
        if not lettered:
            return
        score = self.scores([c for _, c in lettered])
        allowed = self.scripts[[script_of(c) for _, c in lettered]]
        allowed[~allowed.any(1)] = True  # a script that no training text has narrows nothing
        score -= np.where(allowed, score, -np.inf).max(1, keepdims=True)
        np.maximum(score, self.floor, out=score)  # one odd word alone doesn't decide
        score[~allowed] = self.excluded
        while self.n + len(lettered) > len(self.table):
            self.table, self.weight = np.vstack([self.table, np.zeros_like(self.table)]), np.concatenate([self.weight, self.weight * 0])
        self.table[self.n : self.n + len(lettered)] = score
        self.weight[self.n : self.n + len(lettered)] = [len(c) for _, c in lettered]
        for i, (w, _) in enumerate(lettered):
            self.rows[w] = self.n + i
        self.n += len(lettered)

    def path(self, s: np.ndarray) -> np.ndarray:
        """Viterbi labels of the words with scores s.

        Against the label that is best for all, each beginning and each end of a stretch of other labels gains, or it
        would be cheaper without, and the whole gains its two switches; at the text's edge one switch less. The best
        other label of each word bounds these gains, and only runs that reach them are searched.
        """
        best, n = int(s.sum(0).argmax()), len(s)
        out = np.full(n, best)
        if s.shape[1] < 2:
            return out
        other = s.astype(np.float64)
        own = other[:, best].copy()
        other[:, best] = -np.inf
        more = other.max(1) - own
        more[0] += self.penalty
        more[-1] += self.penalty
        gain = np.concatenate([[0.0], np.cumsum(more)])
        ahead = gain[1:] - np.minimum.accumulate(gain)[1:]  # the most that a run of words up to here gains
        if float(ahead.max()) <= 2 * self.penalty:
            return out
        back = np.maximum.accumulate(gain[::-1])[::-1][:-1] - gain[:-1]  # and one from here on
        edge = np.flatnonzero(np.diff(np.concatenate([[False], (ahead > 0) & (back > 0), [False]])))
        for i, j in edge.reshape(-1, 2).tolist():
            if float(ahead[i:j].max()) > 2 * self.penalty:
                out[i:j] = self._search(s[i:j], best if i else None, best if j < n else None)
        return out

    def _search(self, s: np.ndarray, before: int | None, after: int | None) -> list[int]:
        """Best labels of the words with scores s, between words labelled before and after (None: the text's edge)."""
        rows, back, penalty = s.astype(np.float64).tolist(), [], self.penalty
        if before is not None:
            rows[0] = [x - penalty * (k != before) for k, x in enumerate(rows[0])]
        if after is not None:
            rows[-1] = [x - penalty * (k != after) for k, x in enumerate(rows[-1])]
        total = rows[0]
        for r in rows[1:]:
            cut = max(total) - penalty
            if min(total) >= cut:
                back.append(None)  # all stay
            else:
                top = total.index(max(total))
                back.append([x if v >= cut else top for x, v in enumerate(total)])
                total = [v if v >= cut else cut for v in total]
            total = [v + x for v, x in zip(total, r, strict=True)]
        at = total.index(max(total))
        out = [at]
        for move in reversed(back):
            at = at if move is None else move[at]
            out.append(at)
        return out[::-1]

    def label(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the words with letters, and their numbers of letters; nothing where nothing was learned."""
        if not self.names:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        words = text.lower().split()
        at = list(map(self.rows.get, words))
        if None in at:
            if self.used > self.most_bytes:
                self.reset()
                at = [None] * len(words)
            self.learn(list({w for w, a in zip(words, at, strict=True) if a is None}))
            at = list(map(self.rows.__getitem__, words))
        at = np.array(at, dtype=np.int64)
        at = at[at >= 0]
        if not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        return self.path(self.table[at]), self.weight[at]

    def spans(self, text: str) -> list[tuple[str, int]]:
        """(language, words) of the runs of one label."""
        labels, _ = self.label(text)
        cuts = np.flatnonzero(np.diff(labels)) + 1
        return [(self.names[r[0]], len(r)) for r in np.split(labels, cuts) if len(r)]

    def predict(self, text: str | None) -> tuple[str, float]:
        labels, weight = self.label(text or "")
        if not len(labels):
            return "und", 0.0
        share = np.bincount(labels, weight, minlength=len(self.names))
        top = int(share.argmax())
        return self.names[top], float(share[top] / share.sum())


@functools.lru_cache(maxsize=1)
def _labeller(key: int, model: bytes, penalty: float) -> Labeller:
    return Labeller(model, penalty)


def predict(docs: DataFrame, model: bytes, penalty: float = 8.0) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score): the language of most letters, and its share of them.

    `und` and 0 for null text or text without a letter (and for all, where nothing was learned). No shuffle; rows with
    equal or null ids are labelled each; an empty table gives no rows; other columns are ignored. Memory grows with the
    words of a single text, and is bounded between texts.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), zlib.crc32(model)

    def label(rows):
        own = only(_labeller(key, sent.value, penalty))
        for batch in rows:
            texts = batch.column("text").to_pylist()
            got = [own.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: bytes, least: float = 0.5, penalty: float = 8.0) -> DataFrame:
    """Rows of docs, with all their columns, whose text has a language: not `und`, and that language holds `least` of the letters."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), zlib.crc32(model)
    at = docs.columns.index("text")

    def keep(rows):
        own = only(_labeller(key, sent.value, penalty))
        for batch in rows:
            got = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
