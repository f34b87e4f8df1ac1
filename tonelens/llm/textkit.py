"""Code points, words and word windows of a batch of texts as numpy arrays.

One batch of texts is laid end to end in one array of code points; words, their
64-bit hashes and windows of k words are then found with array operations, so
the Python cost of a text is a few array passes and no loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Code points handled together; a longer text makes a slice of its own.
SLICE_CHARS = 1 << 20
LAST = 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def alnum() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return np.fromiter((chr(c).isalnum() for c in range(LAST)), bool, LAST)


@lru_cache(1)
def lower() -> np.ndarray:
    """Lower-cased code point, where that is one code point."""
    out = np.arange(LAST, dtype=np.uint32)
    for c in np.flatnonzero(alnum()).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@lru_cache(1)
def _code_values() -> np.ndarray:
    return mix(lower().astype(U64) + U64(0x51ED27))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        p = np.full(n, b, U64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(_BASE), run(_BASE_INV)


def _room(n: int) -> int:
    return max(1 << 16, 1 << int(n).bit_length())


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts with at most ``limit`` characters, or of one longer text."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(texts):
        yield start, len(texts)


class Codes:
    """Code points of texts, each followed by U+0000. Null counts as the empty text."""

    def __init__(self, texts: list):
        self.texts = [t or "" for t in texts]
        self.n = len(self.texts)
        lengths = np.fromiter(map(len, self.texts), np.int64, self.n)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.lengths = lengths
        self.cp = np.frombuffer(("\0".join(self.texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position; positions ascend."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.starts)))


class Words:
    """Words (maximal runs of letters and digits, lower-cased) of texts: start, end, doc, hash.

    ``first`` has the index of each text's first word, with the total at its end.
    """

    def __init__(self, codes: Codes):
        self.codes = codes
        inside = alnum()[codes.cp]
        inside[codes.starts[1:] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, codes.starts)
        self.doc = np.repeat(np.arange(codes.n), np.diff(self.first))
        up, down = (p[: len(codes.cp)] for p in _powers(_room(len(codes.cp))))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(_code_values()[codes.cp] * up, dtype=U64)])
        at = self.start if len(self.start) else np.zeros(0, np.int64)
        self.hash = mix((total[self.end] - total[at]) * down[at] + (self.end - at).astype(U64))

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        c = self.codes
        d = self.doc[i]
        return c.texts[d][self.start[i] - c.starts[d] : self.end[i] - c.starts[d]].lower()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one text."""
        n = len(self) - k + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        h = np.zeros(n, U64)
        for j in range(k):
            h = (h + self.hash[j : j + n]) * U64(_BASE)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(h[at])


def first_of(sorted_key: np.ndarray) -> np.ndarray:
    """Indices at which a new value begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(sorted_key) else np.zeros(0, np.int64)
