"""NumPy helpers shared by the word-window operators: words, window hashes, MinHash.

They work on a batch of texts at once, inside one Spark task.  A word is a maximal run of
characters other than space and U+0009..U+000D, unchanged.  A word is hashed as a whole; a window of words
by scrambling pairs of shorter windows together, so that no choice of words cancels out.  Hashes
are equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

_U = np.uint64
_ODD = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers; another one for each salt."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] for each i that has as many."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out, at, size = np.full(n, _U(width)), 0, 1
    while True:
        if width & size:
            out = mix(out * _ODD + h[at : at + n])
            at += size
        if size * 2 > width:
            return out
        h = mix(h[:-size] * _ODD + h[size:], 1)
        size *= 2


class Words:
    """Words of a batch of texts: a hash each, and where each text's words begin."""

    def __init__(self, texts: list[str]) -> None:
        self._take([t.encode("utf-8", "surrogatepass").split() for t in texts])

    @classmethod
    def of(cls, parts: list[list[bytes]]) -> Words:
        """Texts that are given as words."""
        words = cls.__new__(cls)
        words._take(parts)
        return words

    def _take(self, parts: list[list[bytes]]) -> None:
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(parts)), counts)
        self.n = int(self.first[-1])
        self.hashes = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(parts)), dtype=np.uint64, count=self.n)

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all runs of so many words, also of those that leave a text."""
        return window_hashes(self.hashes, width)

    def starts(self, width: int) -> np.ndarray:
        """Positions at which a window of so many words of one text starts."""
        if self.n < width:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(self.n - width + 1)
        return at[self.doc[at] == self.doc[at + width - 1]]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each window; a text of fewer words has one window of all of them."""
        at = self.starts(width)
        counts = np.diff(self.first)
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = counts[short].astype(np.uint64)
        for k in range(width - 1):
            more = counts[short] > k
            whole[more] = mix(whole[more] * _ODD + self.hashes[self.first[short[more]] + k], 2)
        return np.concatenate([self.doc[at], short]), np.concatenate([self.windows(width)[at], whole])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i that has as many."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def unique_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) sorted, each pair once; fewer than 65,536 texts."""
    doc, h = words.shingles(width)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, h = doc[order], h[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    return doc[keep], h[keep]


def minhash(doc: np.ndarray, shingle: np.ndarray, n_texts: int, bins: int) -> np.ndarray:
    """One-permutation MinHash, uint32 of shape (texts, bins).

    A bin left empty is filled from a further permutation, and so on, so that any two texts
    agree in a bin with a probability equal to their Jaccard similarity.  Texts without
    shingles stay at the largest value.
    """
    none = np.uint32(2**32 - 1)
    out = np.full((n_texts, bins), none, dtype=np.uint32)
    flat, rounds = out.reshape(-1), 0
    while len(doc):
        x = mix(shingle, 100 + rounds)
        cell = doc * bins + ((x >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        value = np.minimum((x & _U(2**32 - 1)).astype(np.uint32), none - np.uint32(1))
        if rounds:
            empty = flat[cell] == none
            cell, value = cell[empty], value[empty]
        np.minimum.at(flat, cell, value)
        rounds += 1
        todo = (out == none).any(axis=1)
        keep = todo[doc]
        doc, shingle = doc[keep], shingle[keep]
    return out


def batches(texts: list[str], ids: np.ndarray, limit: int = 3_000_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """Slices of at most so many characters (or one text), to bound memory."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > limit or i - begin >= 60_000):
            yield texts[begin:i], ids[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield texts[begin:], ids[begin:]
