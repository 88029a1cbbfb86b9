"""Exact tokenizer output at the price of one look-up for each different piece of a batch of texts.

Texts are cut only where a pre-token ends and the next one starts, whatever is further away, in both tokenizer families
used here: before white space that follows something else; after a single white-space character other than a space; and
between letters and marks. Only a space joins what follows it, and no pre-token holds letters and marks. So the ids of a
text are the ids of its pieces one after another, each as the library gives them.
"""

from __future__ import annotations

import functools
import struct
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from .common import Cache

#: Marks that, after letters, make one pre-token together in both families.
MARKS = ".,;:!?%&*#$()-"

#: Characters of the texts that are encoded at once (a longer text by itself), which bounds the arrays of a call.
AT_ONCE = 1 << 22


def _alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    return {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in own)}


ALPHABET = _alphabet()
SPACE = chr(ALPHABET[0x20])


class _Spelled(dict):
    """Characters below U+0250 in the byte-level alphabet; others aren't kept."""

    def __missing__(self, c: str) -> str:
        out = c.encode().decode("latin-1").translate(ALPHABET)
        if c < "\u0250":
            self[c] = out
        return out


SPELLED = _Spelled()

LETTER, MARK, WHITE, UNSURE = 1, 2, 3, 4
#: Classes of ASCII bytes; 0 for all others. No text is cut beside what may be white space (UNSURE).
CLASS = np.array([LETTER if b < 128 and chr(b).isalpha() else MARK if chr(b) in MARKS else WHITE if 9 <= b <= 13 or b == 32 else UNSURE if 28 <= b < 32 else 0 for b in range(256)], dtype=np.uint8)
#: First bytes of the two-byte characters U+00C0 to U+023F and U+0400 to U+047F: letters, but for these: two signs, and one
#: that is two characters in lower case.
TWO = np.isin(np.arange(256), [*range(0xC3, 0xC9), 0xD0, 0xD1])
SIGNS = (0xC397, 0xC3B7, 0xC4B0)
#: First bytes of characters that may be white space: some of C2, E1, E2, E3.
DOUBT = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
DOUBTS = [int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000)]


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which UTF-8 bytes are cut into pieces, and their end; starts: those at which texts begin, and their end."""
    kind = CLASS[data]
    if (high := np.flatnonzero(data >= 0xC2)).size:
        first = data[high]
        if (at := high[TWO[first]]).size:
            at = at[~np.isin(data[at] * np.uint16(256) + data[at + 1], SIGNS)]
            kind[at] = kind[at + 1] = LETTER
        if (at := high[DOUBT[first]]).size:
            long = data[at] != 0xC2
            for at, n in ((at[~long], 2), (at[long], 3)):
                code = sum(data[at + i].astype(np.int64) << 8 * (n - 1 - i) for i in range(n))
                at = at[np.isin(code, DOUBTS)]
                for i in range(n):
                    kind[at + i] = UNSURE
    cut = np.zeros(len(data) + 1, dtype=bool)
    left, right = kind[:-1], kind[1:]
    cut[1:-1] = (right == WHITE) & (left < WHITE) | (left == LETTER) & (right == MARK) | (left == MARK) & (right == LETTER)
    line = np.flatnonzero((left == WHITE) & (right < WHITE) & (data[:-1] != 32))
    cut[line[(line == 0) | (kind[line - 1] < WHITE)] + 1] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class Chunks(Cache):
    """Ids of pieces of texts.

    Where half the bytes are used the pieces become the old ones; those that come up again are taken over, the rest go
    when the next half is used.
    """

    def __init__(self, make, most_bytes: int, plain=None):
        """plain: gives the ids of ASCII letters that may follow a space, if there is a shorter way to them."""
        super().__init__(most_bytes // 2)
        self.make, self.old, self.plain = make, {}, plain or make

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, chunk: str):
        if (ids := self.old.get(chunk)) is None:
            word = chunk[1:] if chunk[:1] == " " else chunk
            ids = self.plain(chunk) if word.isalpha() and word.isascii() else self.make(chunk)
        if (n := len(chunk)) <= self.longest:
            self.used += 180 + 4 * n + len(ids)  # at least what the piece, its ids and the entry take
            if self.used > self.most_bytes:
                kept = dict(self)
                self.clear()
                self.old = kept
            self[chunk] = ids
        return ids


PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


def _bytes(ids: list[int]) -> bytes:
    return PACK[n](*ids) if (n := len(ids)) < len(PACK) else struct.pack(f"<{n}I", *ids)


def _letters(core: str) -> bool:
    """Letters that are one pre-token in both families, and that neither normalises (but for their case)."""
    return core.isalpha() and (core.isascii() or (ord(max(core)) < 0x250 and "\u0130" not in core and is_normalized("NFC", core)))


class ChunkEncoder:
    """Ids of whole texts as little-endian uint32 bytes, as tokenizers gives them with add_special_tokens=False.

    most_bytes bounds the pieces that are kept.
    """

    def __init__(self, path: str, most_bytes: int = 128 << 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.lower = self.whole("A") == self.whole("a")  # the family that lower-cases also drops white space
        self.lead = "" if self.lower else " "
        self.cache, self.tails = Chunks(self.learn, most_bytes, self._plain()), Chunks(self.bpe, most_bytes // 8)

    def forget(self) -> None:
        self.cache.clear()
        self.tails.clear()

    def whole(self, text: str) -> bytes:
        return _bytes(self.lib.encode(text, add_special_tokens=False).ids)

    def learn(self, w: str) -> bytes:
        core = w[1:] if w[0] == " " else w
        if _letters(core):
            return self.bpe(self.lead + core if core is not w else w)
        return self.whole(w) if w.strip(MARKS) else self.tails[w]

    def _plain(self):
        """bpe for ASCII letters, which stand for themselves: with few calls, as most new pieces are such."""
        tokenize, lower, most = self.model.tokenize, self.lower, len(PACK)

        def plain(word: str) -> bytes:
            ids = [t.id for t in tokenize(word.lstrip(" ").lower() if lower else word.replace(" ", SPACE))]
            return PACK[n](*ids) if (n := len(ids)) < most else _bytes(ids)

        return plain

    def bpe(self, token: str) -> bytes:
        """Ids of one pre-token by the library's model, which takes it in the byte-level alphabet."""
        if self.lower:
            token = token.lower()
        if token.isascii():  # letters and marks stand for themselves
            token = token.replace(" ", SPACE)
        else:
            token = "".join(map(SPELLED.__getitem__, token))
        return _bytes([t.id for t in self.model.tokenize(token)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each different piece of all texts is looked up once; Arrow finds them and joins their ids."""
        own = pa.array(texts, pa.large_string())
        _, starts, data = own.buffers()
        starts = np.frombuffer(starts, dtype="<i8")[: len(texts) + 1]
        if not texts or not starts[-1]:
            return [b""] * len(texts)
        at = cuts(np.frombuffer(data, dtype=np.uint8)[: starts[-1]], starts)
        found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).dictionary_encode()
        ids = list(map(self.cache.__getitem__, found.dictionary.to_numpy(zero_copy_only=False).tolist()))
        _, ends, data = pa.array(ids, pa.large_binary()).take(found.indices).buffers()
        ends = np.frombuffer(ends, dtype="<i8")[np.searchsorted(at, starts)].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, most_bytes: int = 128 << 20) -> ChunkEncoder:
    """One encoder for each tokenizer file and Python worker."""
    return ChunkEncoder(path, most_bytes)


def batches(texts: list, most_chars: int = 1 << 20, most: int = 64):
    """Slices (start, end) of texts with bounded characters in each; a single longer text is a slice of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and (chars + n > most_chars or i - start >= most):
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)
