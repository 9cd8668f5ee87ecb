"""Words and hashes of many texts at once, in numpy.

A batch of texts is one byte buffer; a polynomial prefix hash over it gives the hash of
any byte range in constant time. Words are maximal runs of bytes other than ASCII white
space (0x20, 0x09-0x0D), which UTF-8 never uses inside a character.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers for the places of a window of words.
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=U)

_space = np.zeros(256, dtype=bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def powers(n: int, way: str = "up") -> np.ndarray:
    """BASE**i (up) or its inverse (down) for i < n, modulo 2**64."""
    if len(_powers[way]) < n:
        step = BASE if way == "up" else pow(BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            _powers[way] = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1 << 16), step, dtype=U)]))
    return _powers[way][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Hasher:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum((buf.astype(U) + U(1)) * powers(n), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(len(self.sums), "down")[start])


    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each place on."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * powers(n, "down"))


class Words:
    """The words of some texts: start, end (bytes in buf), doc (index of the text), hash."""

    def __init__(self, texts: list[bytes], lower: bool = False, hashed: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.n_docs = len(texts)
        self.buf = _lower[raw] if lower else raw
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        self.doc_end = self.doc_start + lens
        word = ~_space[self.buf]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        #: The words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        if hashed:
            self.hash = Hasher(self.buf).ranges(self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each window of k words within a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        total = np.zeros(len(at), dtype=U)
        for j in range(k):
            total += self.hash[at + j] * PLACES[j]
        return at, mix(total)

    def shingle_sets(self, k: int):
        """For each text, its sorted distinct shingle hashes.

        A text of fewer than k words has its whole sequence as its only shingle; a text
        without words has none.
        """
        at, value = self.windows(k)
        cut = np.searchsorted(self.doc[at], np.arange(self.n_docs + 1)) if len(at) else np.zeros(self.n_docs + 1, np.int64)
        for i in range(self.n_docs):
            a, b = self.first[i], self.first[i + 1]
            if a == b:
                yield np.zeros(0, U)
            elif b - a < k:
                own = (self.hash[a:b] * PLACES[:b - a]).sum(dtype=U) + U(b - a)
                yield mix(np.array([own], dtype=U))
            else:
                yield np.unique(value[cut[i]:cut[i + 1]])
