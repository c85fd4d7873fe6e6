"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``CAPACITY`` tokens.  Only the lengths matter for what goes
together, and there are at most ``CAPACITY`` different ones, so the counts per length (bounded,
however many documents) are all that reaches the driver.  There each bin takes the longest
piece left and, by a bitset subset-sum programme over the lengths still available, the fullest
combination that fits beside it; the same combination is repeated while its lengths last.  Spark
then deals the pieces out: a piece's rank among those of its length, from salted windows and
running totals, names its bin and its place.

Cases: null text counts as empty (one piece, the closing token only); equal rows, and rows with a null
doc_id, are pieces of their own; pieces of equal length take places in order of (doc_id, piece)
within a salt, ties in any order; very long texts are read whole and cut into pieces; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterflow.llm.base import documents, kept, per_batch, settle
from meterflow.llm.bpe import ByteBpe

CAPACITY = 2048
#: The token that closes a document.
CLOSING = 0
SALTS = 64
KEEP = 500_000
#: Fixed value: the pattern that cuts lower-case text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Signs that are set apart before a text is cut, so that fewer different words are left.
APART = ".,"
#: Where such a sign stands beside another one, both are one pre-token and must stay together.
_TOGETHER = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))")
#: U+001C..U+001F are white space for str.split but not for the tokenizer; the lower case of some
#: letters hangs on their place for str.lower; special tokens are matched before anything else.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|", "\u03a3", "\u0130")


class WordIds:
    """Token ids of texts; words between white space are encoded once and kept.

    Texts that need more than lower case and such a cut go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bpe = ByteBpe(path)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """Words that are encoded each by itself; none if the tokenizer must see the text."""
        if not text.isascii() and not is_normalized("NFC", text) or any(x in text for x in _ODD):
            return None
        text = text.lower()
        if not _TOGETHER.search(text):
            for sign in APART:
                text = text.replace(sign, f" {sign} ")
        return text.split()

    def learn(self, words: list[str]) -> None:
        cut = [(w,) if w.isalpha() else self.pattern.findall(w) for w in words]
        tokens = list(set(chain.from_iterable(cut)))
        ids = dict(zip(tokens, (np.array(x, dtype="<u4").tobytes() for x in self.bpe.merge([t.encode() for t in tokens])), strict=True))
        self.known.update(zip(words, (ids[c[0]] if len(c) == 1 else b"".join([ids[t] for t in c]) for c in cut), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.words(t) for t in texts]
        wanted = set(chain.from_iterable(c for c in cut if c))
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > KEEP:
            self.known.clear()
            fresh = wanted
        self.learn(list(fresh))
        return [self.whole(t) if c is None else b"".join(map(self.known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


def _pieces(path: str, capacity: int):
    def work(rows: dict[str, list]) -> dict[str, list]:
        words = kept("words", path, lambda: WordIds(path))
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        closing = int(CLOSING).to_bytes(4, "little")
        for doc_id, ids in zip(rows["doc_id"], words.batch([t or "" for t in rows["text"]]), strict=True):
            ids += closing
            for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                for name, value in (("doc_id", doc_id), ("piece", k), ("start", start // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                    out[name].append(value)
        return out

    return work


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, copies) of the fullest combination of available pieces of at most so much room.

    The bits of ``sums`` are the totals that can be reached; longer pieces come first, so that
    among equally full ones the combination keeps short pieces for later.
    """
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, power = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            take = min(power, left)
            grown = sums | (sums << (length * take)) & mask
            if grown != sums:
                steps.append((length, take, sums))
                sums = grown
            left, power = left - take, power * 2
        if sums >> room & 1:
            break
    total, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if total and not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return sorted(used.items(), reverse=True)


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, copies in each)]) until every piece is in a bin."""
    counts = {k: v for k, v in counts.items() if v}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        inside = dict(fullest(capacity - seed, lengths, counts))
        counts[seed] += 1
        inside[seed] = inside.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in inside.items())
        for k, n in inside.items():
            counts[k] -= n * times
        out.append((times, sorted(inside.items(), reverse=True)))
        lengths = [k for k in lengths if counts[k]]
    return out


def _dealt(bins: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies per bin, first bin, offset) of each part of each combination."""
    out, used, first = [], {}, 0
    for times, inside in bins:
        offset = 0
        for length, copies in inside:
            rank = used.get(length, 0)
            out.append((length, rank, copies * times, copies, first, offset))
            used[length] = rank + copies * times
            offset += length * copies
        first += times
    if len(out) > plan_bound(capacity):
        raise ValueError(f"a plan of {len(out)} parts")
    return out


def plan_bound(capacity: int) -> int:
    """Most parts of a plan, however many pieces there are.

    A step takes its combination as often as it can, so that afterwards some length has fewer pieces
    left than the combination asks for: of a length k at most capacity / k in a bin.  So a length ends
    at most capacity / k + 1 steps, and a step has no more parts than different lengths fit in a bin.
    """
    steps = sum(capacity // k + 1 for k in range(1, capacity + 1))
    return steps * int((2 * capacity) ** 0.5 + 1)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(per_batch(documents(docs), "doc_id long, piece int, start long, length long, ids_crc32 long", _pieces(path, capacity)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()
    parts = _dealt(minimum_slack({r["length"]: r["n"] for r in totals}, capacity), capacity)
    by_length: dict[int, list] = {}
    for length, *rest in parts:
        by_length.setdefault(length, []).append(tuple(rest))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    # At most capacity * SALTS small rows; merged in the partitions that the ranks were taken in.
    placed = ranked.join(before.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "salt")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    table = {length: np.asarray(rows, dtype=np.int64) for length, rows in by_length.items()}
    return _place(placed, table, schema)


def _place(placed: DataFrame, table: dict[int, np.ndarray], schema: str) -> DataFrame:
    """Bin and offset of each ranked piece; the table has at most ``plan_bound`` rows of five numbers."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        length, rank = np.asarray(rows["length"], dtype=np.int64), np.asarray(rows["rank"], dtype=np.int64)
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts):
            part = table[int(length[at[0]])]
            row = part[np.searchsorted(part[:, 0], rank[at], side="right") - 1]
            inside = rank[at] - row[:, 0]
            sequence[at] = row[:, 3] + inside // row[:, 2]
            offset[at] = row[:, 4] + inside % row[:, 2] * length[at]
        return {k: rows[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    return per_batch(placed, schema, work)
