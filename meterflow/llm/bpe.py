"""Byte-level BPE encoding and decoding over a contiguous rank array.

A short word is held as its parts and, beside them, the rank at each inner boundary; the least
rank is looked for again and again, its boundary deleted and the neighbouring ranks refreshed.
Long words use the same order from a heap, so that their cost stays near linear.  Merges
never cross pre-tokens, so what a pre-token encodes to is kept for its next occurrence.

Cases: null text counts as empty, with no ids; special tokens written in a text become
their own ids; other columns are ignored; rows that repeat a doc_id each give a row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from meterflow.llm.base import documents, kept, per_batch

#: Bytes up to which a word counts as short.
SHORT = 64
#: Pre-tokens kept for reuse in a task.
KEEP = 500_000
#: Fixed value: the pattern that cuts texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it; \s of the matching library also takes U+001C..U+001F.
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Where a space may not begin a pre-token of its own word, so that the pattern must decide.
_UNSURE = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = tuple(chr(c) for c in range(128, 0x3001) if chr(c).isspace())
_NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary with its merge ranks.

    A part is its bytes and whether it ends a word in a vocabulary that tells such parts apart.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, end = _byte_letters(), spec["model"].get("end_of_word_suffix") or ""
        special = {t["content"] for t in spec["added_tokens"]}

        def part(text: str) -> tuple[bytes, bool]:
            last = bool(end) and text.endswith(end)
            return bytes(letters[c] for c in (text.removesuffix(end) if last else text)), last

        self.id_of = {part(w): n for w, n in spec["model"]["vocab"].items() if w not in special}
        self.rank: dict[tuple[tuple[bytes, bool], tuple[bytes, bool]], int] = {}
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[part(a), part(b)] = i
        self.ends = bool(end)
        self.byte_id = np.array([self.id_of[bytes([b]), False] for b in range(256)], dtype=np.int64)
        self.last_id = np.array([self.id_of[bytes([b]), self.ends] for b in range(256)], dtype=np.int64)
        pairs = sorted((self.id_of[a] << 32 | self.id_of[b], i) for (a, b), i in self.rank.items())
        self.pair_key, self.pair_rank = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.made = np.array([self.id_of[a[0] + b[0], b[1]] for a, b in self.rank], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {n: w[0] for w, n in self.id_of.items()} | {n: t.encode() for t, n in self.special.items()}
        self.name_of = [str(i) for i in range(max(self.bytes_of) + 1)]
        strict = PATTERN.replace(r"[^\s", f"[^{_SPACES}").replace(r"\s+(?!\S)|\s+", f"[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
        self.pattern = regex.compile(strict)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: piece -> its ids joined by commas; and what it decodes to, where that is another text.
        self.known: dict[str, str] = {}
        self.differs: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token; short ones of one length are merged together, a row each."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) <= SHORT:
                by_size.setdefault(len(word), []).append(i)
            else:
                out[i] = [self.id_of[p] for p in self._long(word)]
        for size, at in by_size.items():
            if size:
                raw = np.frombuffer(b"".join([words[i] for i in at]), dtype=np.uint8).reshape(len(at), size)
                parts = self.byte_id[raw]
                parts[:, -1] = self.last_id[raw[:, -1]]
                self._short(parts, np.asarray(at), out)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def _short(self, parts: np.ndarray, at: np.ndarray, out: list[list[int]]) -> None:
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while True:
            n = parts.shape[1]
            if n > 1:
                where = ranks.argmin(axis=1)
                least = np.take_along_axis(ranks, where[:, None], 1)[:, 0]
                go = least < _NONE
            else:
                go = np.zeros(len(at), dtype=bool)
            for i, ids in zip(at[~go], parts[~go].tolist(), strict=True):
                out[i] = ids
            if not go.any():
                return
            at, parts, ranks, where, least = at[go], parts[go], ranks[go], where[go], least[go]
            row, column = np.arange(len(at)), np.arange(n - 1)
            parts[row, where] = self.made[least]
            parts = np.take_along_axis(parts, column + (column > where[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= where[:, None]), 1)
            for side in (where, where - 1):
                ok = (side >= 0) & (side < n - 2)
                r, c = row[ok], side[ok]
                ranks[r, c] = self._ranks(parts[r, c], parts[r, c + 1])

    def _long(self, word: bytes) -> list[tuple[bytes, bool]]:
        n = len(word)
        end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < n:
                r = self.rank.get(((word[i:j], False), (word[j : end[j]], self.ends and end[j] == n)))
                if r is not None:
                    heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not live[i] or end[i] != j or j >= n or not live[j] or end[j] != k:
                continue
            live[j], end[i] = False, k
            if k < n:
                before[k] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [(word[i : end[i]], self.ends and end[i] == n) for i in range(n) if live[i]]

    def _learn(self, pieces: set[str]) -> None:
        """Encodes and decodes pieces that are cut alike in any place."""
        if len(self.known) + len(pieces) > KEEP:
            self.known.clear()
            self.differs.clear()
        cut = {p: (p,) if p in self.special or p[p[0] == " " :].isalpha() else self.pattern.findall(p) for p in pieces}
        fresh = list(set(chain.from_iterable(cut.values())).difference(self.special))
        raw = [t.encode("utf-8", "surrogatepass") for t in fresh]
        text, bad, name, spell = {t: str(n) for t, n in self.special.items()}, {}, self.name_of, self.bytes_of
        for token, word, ids in zip(fresh, raw, self.merge(raw), strict=True):
            text[token] = ",".join([name[i] for i in ids])
            decoded = b"".join([spell[i] for i in ids])
            if decoded != word:
                bad[token] = decoded
        for piece, tokens in cut.items():
            self.known[piece] = text[tokens[0]] if len(tokens) == 1 else ",".join([text[t] for t in tokens])
            if bad and not bad.keys().isdisjoint(tokens):
                self.differs[piece] = b"".join([bad.get(t) or t.encode() for t in tokens])

    def _pieces(self, text: str) -> list[str]:
        """Parts that end where a pre-token surely ends."""
        if any(x in text for x in _UNSURE) or text[-2:-1].isspace() or (not text.isascii() and any(x in text for x in _WIDE)):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]

    def batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, text that they decode to) of each text."""
        cut: list[list[str]] = []
        for text in texts:
            special = self.split_special and any(s in text for s in self.special)
            parts = self.split_special.split(text) if special else [text]
            cut.append([piece for part in parts if part for piece in ([part] if part in self.special else self._pieces(part))])
        wanted = set(chain.from_iterable(cut))
        fresh = wanted.difference(self.known)
        if fresh:
            self._learn(fresh if len(self.known) + len(fresh) <= KEEP else wanted)
        known, differs, out = self.known, self.differs, []
        for pieces in cut:
            odd = differs and not differs.keys().isdisjoint(pieces)
            decoded = b"".join([differs.get(p) or p.encode() for p in pieces]).decode("utf-8", "replace") if odd else "".join(pieces)
            out.append((",".join(map(known.__getitem__, pieces)), decoded))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.batch([text])[0][0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def round_trips(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids) of each document."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        bpe = kept("bpe", path, lambda: ByteBpe(path))
        out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
        for ids, decoded in bpe.batch([t or "" for t in rows["text"]]):
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append([int(x) for x in ids.split(",")] if ids else [])
        return out

    return per_batch(documents(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, work)
