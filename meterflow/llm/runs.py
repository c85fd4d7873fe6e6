"""Periodic runs of words: where a text says the same words over and over.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES``
periods long, that no neighbouring word extends.  For each text:

1. Every run repeats its words at distance q for at least three periods, so all its 5-word windows
   occurred before, at most a third of the stretch ago.  Hashes of windows find the stretches that could
   hold a run; most texts have none.  Equal windows have equal hashes, so no run is passed over.
2. A stretch becomes a suffix automaton.  Its suffix links are a tree, kept as a link-cut tree: word
   after word, the path from the state of the prefix to the root is accessed and takes the colour of that
   word, the last occurrence of all strings on it.  A segment that had colour e until then ends at the
   longest string, L words, that the prefixes ending at e and at the new word i have in common; with
   q = i - e and L >= (TIMES - 1) * q the L + q words up to i have period q.
3. Such repetitions begin as early as they can; the last word at which one is seen is where its run ends.
   The period is the smallest one, as a smaller one would have coloured the segment later than e.

Cases: null, empty and wordless texts have no runs; rows are judged each on its own, whatever their ids
and copies; runs of equal length/period are told apart by start, then period; very long texts are read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from meterflow.llm.base import documents, per_batch
from meterflow.llm.grams import Words, batches, mix

#: Words and periods that a run has at least; the argument of step 3 needs three periods or more.
LEAST, TIMES = 6, 4
#: Words of the windows that find stretches: what a run repeats is never shorter.
WINDOW = LEAST - 1


def suffix_automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, at): longest string and suffix link of each state, and the state of each prefix; 1 is the root, 0 none."""
    length, link, steps, at = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for i, c in enumerate(ids):
        new = len(length)
        length.append(i + 1)
        link.append(1)
        steps.append({})
        p = last
        while p and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                steps.append(steps[q].copy())
                link[q] = link[new] = clone
                while p and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
        last = new
        at.append(new)
    return length, link, at


class LinkCutTree:
    """Paths of one colour in a fixed tree, each a splay tree ordered by depth; the colour stands at its root."""

    def __init__(self, parent: list[int]) -> None:
        self.up, n = list(parent), len(parent)
        self.left, self.right, self.colour = [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from node to the root one colour; (deepest node, former colour) of each segment on it, from below."""
        passed, below, v = [], 0, node
        while v:
            self._splay(v)
            before, rest = self.colour[v], self.right[v]
            if before >= 0:
                passed.append((v, before))
            if rest:
                self.colour[rest] = before
            self.right[v], below, v = below, v, self.up[v]
        self.colour[below] = colour
        return passed


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not told apart")
    length, link, at = suffix_automaton(ids)
    tree, ends = LinkCutTree(link), {}
    for i, state in enumerate(at):
        for node, before in tree.access(state, i):
            q, common = i - before, length[node]
            if common >= (times - 1) * q and common + q >= least:
                ends[i - common - q + 1, q] = i
    return sorted((start, end - start + 1, q) for (start, q), end in ends.items())


def stretches(words: Words, times: int = TIMES) -> list[tuple[int, int]]:
    """Words [from, to) that may hold runs, with a word more on either side; apart from each other, in order."""
    at = words.starts(WINDOW)
    if not len(at):
        return []
    h = mix(words.windows(WINDOW)[at] ^ mix(words.doc[at].astype(np.uint64), 3))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    later = order[1:][same]
    start, back = at[later], at[later] - at[order[:-1][same]]
    order = np.argsort(start)
    start, back = start[order], back[order]
    while len(start):
        # Windows next to each other, in one text, make a stretch; what it repeats is a bound on the period.
        cut = np.flatnonzero((np.diff(start) != 1) | (words.doc[start[1:]] != words.doc[start[:-1]])) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([first, [len(start)]]))
        bound = (size + WINDOW - 1) // (times - 1)
        keep = back <= np.repeat(bound, size)
        if keep.all():
            doc = words.doc[start[first]]
            low = np.maximum(words.first[doc], start[first] - bound - 1)
            high = np.minimum(words.first[doc + 1], start[first] + size + WINDOW)
            out: list[tuple[int, int]] = []
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                # Texts lie next to each other: what overlaps is of one text.
                if out and a < out[-1][1]:
                    out[-1] = (out[-1][0], max(b, out[-1][1]))
                else:
                    out.append((a, b))
            return out
        start, back = start[keep], back[keep]
    return []


def text_runs(parts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    words = Words.of(parts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    for a, b in stretches(words):
        doc = int(words.doc[a])
        shift, seen = a - int(words.first[doc]), {}
        ids = [seen.setdefault(w, len(seen)) for w in parts[doc][shift : shift + b - a]]
        out[doc] += [(start + shift, n, q) for start, n, q in runs_of(ids)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run says again after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, n, q in runs:
        keep[start + q : start + n] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def repeating(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth id (by CRC) with an end that repeats a part of it; a null id has its words as they are."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), their digest, the digest of the collapsed text (and that text).

    ``change`` rewrites the words of a document, given with its id, before they are searched.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "runs", "runs_sha256", "collapsed_sha256", *["collapsed"] * texts)}
        for some, at in batches([t or "" for t in rows["text"]], np.arange(len(rows["text"]))):
            ids = [rows["doc_id"][i] for i in at]
            parts = [t.encode("utf-8", "surrogatepass").split() for t in some]
            if change:
                parts = [change(p, i) for p, i in zip(parts, ids, strict=True)]
            found = text_runs(parts)
            out["doc_id"] += ids
            for p, runs in zip(parts, found, strict=True):
                left = b" ".join(collapsed(p, runs))
                out["n_words"].append(len(p))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out["runs_sha256"].append(hashlib.sha256("".join([f"{s},{n},{q}\n" for s, n, q in runs]).encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
                if texts:
                    out["collapsed"].append(left.decode("utf-8", "replace"))
        return out

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"
    return per_batch(documents(docs), schema + ", collapsed string" * texts, work)


def digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of most periods, and the digests."""
    # Runs are sorted: of equal ones the first stays.
    more = "aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) -> case when b is null or r.length * b.period > b.length * r.period then r else b end)"
    best = found.selectExpr("*", f"{more} as best")
    return best.selectExpr("doc_id", "cast(size(runs) as long) as n_runs", "best.start", "best.length", "best.period", "(1000 * best.length) div best.period as exponent_milli", "runs_sha256", "collapsed_sha256")
