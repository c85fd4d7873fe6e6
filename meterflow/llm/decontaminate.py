"""Benchmark decontamination: passages of test items inside training texts.

Words are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case.  A
window is ``WINDOW`` consecutive words of an item; an item of fewer words is one window.

1. Items are cut into pieces that overlap by a window less a word, equal ones once, and dealt to shards of at
   most ``SHARD`` bytes (words count ``WORD`` bytes more), which is checked when a shard is read.  There
   is one shard unless the items are many; each further one is another pass over the texts.
2. The pieces of a shard are broadcast, and each Python worker makes one generalised suffix automaton of them.
3. The words of a text stream through the automaton, which knows at each word the longest stretch ending there
   that any item has.  Its first two steps, known words and known pairs, are taken for all words of a
   batch at once; only stretches that pass them, which few do, go on word by word.
4. Where the longest stretch has ``WINDOW`` words or more, its last ``WINDOW`` words are a window; the state that
   they lead to knows their items.  Items shorter than a window are found on the chain of suffix links.

Cases: null, empty and wordless texts have no words and are clean; items without words have no windows;
rows of one item_id are one item, a null id is an item written as "null"; texts are judged each on its own,
equal texts alike, whatever their ids; very long texts and items are read whole; without texts there are
no rows, without items all texts are clean; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.base import documents, fields, kept, per_batch, settle
from meterflow.llm.grams import batches

WINDOW = 10
#: Words of one piece of an item; bytes of one shard of pieces, and bytes that each word counts more.
PIECE, SHARD, WORD = 4096, 2**21, 8
#: Cells of the table of known pairs; a pair that shares a cell with another one is only looked at closer.
PAIRS = 2**22
#: Share of hit words from which on a text goes as a whole.
COVERAGE = 0.5

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _LETTERS else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Found(NamedTuple):
    """Hit stretches (first word, words) and the items whose windows occur."""

    spans: list[tuple[int, int]]
    items: list[str]


class Automaton:
    """Generalised suffix automaton of pieces of items, (item, words); 0 is the root."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.length, self.link, self.steps = [0], [-1], [{}]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in pieces if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._append(last, c)
        #: The state of the last ``window`` words, from any state that has as many.
        self.short = [0] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.short[v] = v if self.length[self.link[v]] < window else self.short[self.link[v]]
        self.items: dict[int, set[str]] = {}
        #: Items of fewer words than a window: at their state, how many words they have; and the next such state upwards.
        self.whole: dict[int, dict[int, set[str]]] = {}
        for item, ids in coded:
            v = 0
            for k, c in enumerate(ids):
                v = self.steps[v][c]
                if k + 1 >= window:
                    self.items.setdefault(self.short[v], set()).add(item)
            if len(ids) < window:
                self.whole.setdefault(v, {}).setdefault(len(ids), set()).add(item)
        self.above = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.above[v] = v if v in self.whole else self.above[self.link[v]] if v else -1
        #: Fewest words of a window, and the table of pairs.
        self.least = min([window, *[n for by in self.whole.values() for n in by]])
        self.pair = np.zeros(PAIRS, dtype=bool)
        for _, ids in coded:
            x = np.asarray(ids, dtype=np.int64)
            self.pair[self._cell(x[:-1], x[1:])] = True

    def _append(self, last: int, c: int) -> int:
        length, link, steps = self.length, self.link, self.steps
        if c in steps[last]:
            q = steps[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new, p = len(length), last
        length.append(length[last] + 1)
        link.append(0)
        steps.append({})
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        length, link, steps = self.length, self.link, self.steps
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        steps.append(steps[q].copy())
        link[q] = clone
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = clone
            p = link[p]
        return clone

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) % PAIRS

    def stretches(self, parts: list[list[bytes]]) -> list[tuple[int, int, int]]:
        """(text, from, to): stretches of known words in known pairs, as long as the shortest window."""
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        first, n = np.concatenate([[0], np.cumsum(sizes)]), int(sizes.sum())
        if not n or not self.ids:
            return []
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for p in parts for w in p), dtype=np.int64, count=n)
        joined = np.zeros(n + 1, dtype=bool)  # is word i joined to the one before?
        joined[1:n] = (ids[1:] >= 0) & (ids[:-1] >= 0)
        joined[first] = False
        at = np.flatnonzero(joined)
        joined[at] = self.pair[self._cell(ids[at - 1], ids[at])]
        starts = np.flatnonzero((ids >= 0) & ~joined[:n])
        if not len(starts):
            return []
        broken = np.flatnonzero(~joined)
        ends = broken[np.searchsorted(broken, starts, side="right")]
        keep = ends - starts >= self.least
        starts, ends = starts[keep], ends[keep]
        doc = np.searchsorted(first, starts, side="right") - 1
        return list(zip(doc.tolist(), (starts - first[doc]).tolist(), (ends - first[doc]).tolist(), strict=True))

    def longest(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(state, words) of the longest stretch of any item that ends at each word."""
        steps, link, length, ids = self.steps, self.link, self.length, self.ids
        v, n, out = 0, 0, []
        for w in words:
            c = ids.get(w, -1)
            while v and c not in steps[v]:
                v = link[v]
                n = length[v]
            if c in steps[v]:
                v, n = steps[v][c], n + 1
            out.append((v, n))
        return out

    def search(self, parts: list[list[bytes]]) -> dict[int, Found]:
        """What is found in each text that holds a window."""
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for doc, a, b in self.stretches(parts):
            for i, (v, n) in enumerate(self.longest(parts[doc][a:b]), a + 1):
                best = 0
                if n >= self.window:
                    best = self.window
                    hits.setdefault(doc, ([], set()))[1].update(self.items.get(self.short[v], ()))
                u = self.above[v]
                while u >= 0:
                    for size, items in self.whole[u].items():
                        if size <= n:
                            best = max(best, size)
                            hits.setdefault(doc, ([], set()))[1].update(items)
                    u = self.above[self.link[u]] if u else -1
                if best:
                    hits[doc][0].append((i - best, best))
        return {d: Found(merged(s), sorted(items)) for d, (s, items) in hits.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - out[-1][0]))
        else:
            out.append((a, n))
    return out


def pieces(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, piece (words joined by a space), size: equal ones once."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item": [], "piece": [], "size": []}
        for item, text in zip(rows["item"], rows["text"], strict=True):
            words = words_of(text)
            for a in range(0, max(len(words) - window + 1, 1), PIECE - window + 1):
                part = words[a : a + PIECE]
                if part:
                    out["item"].append(item)
                    out["piece"].append(b" ".join(part).decode("utf-8", "surrogatepass"))
                    out["size"].append(sum(map(len, part)) + WORD * len(part))
        return out

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return per_batch(named, "item string, piece string, size long", work).distinct()


def shards(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """The pieces with their shard, and the number of shards, none of which is over ``SHARD`` bytes (but one piece alone may be)."""
    cut = settle(pieces(items, window))
    total = cut.agg(F.sum("size")).first()[0] or 0
    count = 1 if total <= SHARD else 2 * -(-total // SHARD)
    while True:
        dealt = cut.withColumn("shard", F.pmod(F.xxhash64("item", "piece"), F.lit(count)))
        worst = dealt.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(f"size > {SHARD} and n > 1")
        if worst.isEmpty():
            return dealt, count
        count *= 2


_SCANNED = "n_words long, spans array<struct<start:long,length:long>>, items array<string>"


def _scan(docs: DataFrame, shard: DataFrame, window: int, keep: list[str]) -> DataFrame:
    """The kept columns and what the items of one shard are found to hit."""
    # At most SHARD bytes: shards() checked it.
    rows = docs.sparkSession.sparkContext.broadcast([(r["item"], r["piece"].encode("utf-8", "surrogatepass").split(b" ")) for r in shard.select("item", "piece").collect()])
    key = uuid.uuid4().hex

    def work(got: dict[str, list]) -> dict[str, list]:
        automaton = kept("decontaminate", (key, window), lambda: Automaton(rows.value, window))
        out: dict[str, list] = {k: [] for k in (*keep, "n_words", "spans", "items")}
        for texts, at in batches([t or "" for t in got["text"]], np.arange(len(got["text"]))):
            parts = [words_of(t) for t in texts]
            found = automaton.search(parts)
            for k in keep:
                out[k] += [got[k][i] for i in at]
            out["n_words"] += map(len, parts)
            for i in range(len(parts)):
                spans, items = found.get(i, ((), ()))
                out["spans"].append([{"start": a, "length": n} for a, n in spans])
                out["items"].append(list(items))
        return out

    return per_batch(docs, fields(docs, keep, _SCANNED), work)


def _one(rows: dict[str, list]) -> dict[str, list]:
    """Stretches and items that several shards found, as one."""
    joined = [merged([(x["start"], x["length"]) for x in spans]) for spans in rows["spans"]]
    return rows | {"spans": [[{"start": a, "length": n} for a, n in s] for s in joined], "items": [sorted(set(i)) for i in rows["items"]]}


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, *more: str) -> DataFrame:
    """doc_id, text, other named columns, n_words, spans (first word and number of hit words), items (sorted)."""
    texts = documents(docs, *more)
    dealt, count = shards(items, window)
    if count == 1:
        return _scan(texts, dealt, window, texts.columns)
    # Equal texts are hit alike, so that what the shards find in a text meets by the text.
    keyed = texts.withColumns({"h": F.xxhash64("text"), "h2": F.sha2(F.coalesce("text", F.lit("")), 256)})
    passes = [_scan(keyed, dealt.where(F.col("shard") == i), window, ["h", "h2"]).where("size(spans) > 0").distinct() for i in range(count)]
    hit = passes[0]
    for other in passes[1:]:
        hit = hit.union(other)
    # At most one row for each shard.
    both = settle(hit.groupBy("h", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")))
    none = _scan(keyed, dealt.where("false"), window, [*texts.columns, "h", "h2"]).drop("spans", "items")
    joined = none.join(both, ["h", "h2"], "left").withColumns({"spans": F.coalesce("spans", F.array()), "items": F.coalesce("items", F.array())}).select(*texts.columns, "n_words", "spans", "items")
    return per_batch(joined, joined.schema, _one)


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the items, and whether any word is hit."""
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without stretches of words, each from its first word to the one after it."""
    if not spans:
        return text
    at = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
    out, now = [], 0
    for a, n in spans:
        out.append(text[now : at[a]])
        now = at[a + n]
    return "".join([*out, text[now:]])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents, all columns, without hit stretches; texts of which a larger share than ``coverage`` is hit go."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = contamination(whole, items, window, "row").where(n_hit() <= coverage * F.col("n_words"))

    def work(rows: dict[str, list]) -> dict[str, list]:
        cut = [t if not s else without(t, [(x["start"], x["length"]) for x in s]) for t, s in zip(rows["text"], rows["spans"], strict=True)]
        return {"row": rows["row"], "left": cut}

    kept_rows = per_batch(found.select("row", "text", "spans"), fields(found, ["row"], "left string"), work)
    return kept_rows.select(*[F.col("left").alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns])


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle() -> str:
    """The rows of ``digest`` over documents and benchmark, in DuckDB SQL."""
    return f"""
with d as (select doc_id, {_CUT} as w from documents),
b as (select coalesce(item_id::varchar, 'null') as item, {_CUT} as w from benchmark),
win as (select distinct item, least(len(w), {WINDOW}) as k, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') as s from (select *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as p from b where len(w) > 0)),
spots as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win) where len(w) >= k)),
found as (select doc_id, p, k, s from spots where s in (select s from win)),
hit as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + k)) as q from found) group by 1),
its as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct doc_id, item from found join win using (k, s)) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, hit.n is not null as contaminated from d left join hit using (doc_id) left join its using (doc_id)"""
