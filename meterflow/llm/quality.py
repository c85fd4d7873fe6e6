"""Quality rules: counts per document, and its divergence from language references.

References are the character-class and common-word histograms of all documents of a
language (``lang``) that pass the base rules, each with ``PRIOR`` words of the average of all such documents
added, so that a language of few documents is judged much as all are, and one of many by its own; null is a
language only if there is no other.  Common words are the ``COMMON`` words with a letter, in lower case, that are most
frequent then.  A document that passes the base rules is kept if one language accepts both its histograms: the
Jensen-Shannon distance of its character classes is at most ``CLASS_LIMIT``, and that of its words at most
``WORD_LIMIT`` and ``WORD_SHARE`` of the distance of a text without any common word, so that texts of
words that are frequent nowhere do not accept each other.  Texts under ``LEAST_CHARS`` characters or
``LEAST_WORDS`` words are too short to be judged by the one or the other.

Cases: null or empty text has no words and fails the base rules; without references all that pass the
base rules are kept; rows that repeat a doc_id, also a null one, are judged each on its own; of equally
frequent words the first in order is common; very long texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.base import fields, per_batch, prepare, settle, without_gc
from meterflow.llm.grams import Words, batches

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANK = "\t\n\x0b\x0c\r "
RUN, LEAST, MOST_REPEATED = 8, 20, 30
COMMON, PRIOR = 64, 2000
LEAST_CHARS, LEAST_WORDS = 300, 50
CLASS_LIMIT, WORD_LIMIT, WORD_SHARE = 0.31, 0.48, 0.97
#: Character classes: blank, symbol, lower case, upper case, digit, sentence sign, other letter, rest.
N_CLASSES = 8


def _classes() -> np.ndarray:
    out = np.full(65536, 7, dtype=np.uint8)
    for code in range(65536):
        c = chr(code)
        if c.islower():
            out[code] = 2
        elif c.isupper():
            out[code] = 3
        elif c.isalpha():
            out[code] = 6
        elif c.isdigit():
            out[code] = 4
    for chars, kind in ((BLANK, 0), (SYMBOLS, 1), (".,;:!?'\"()-", 5)):
        out[[ord(c) for c in chars]] = kind
    return out


_CLASS: list[np.ndarray] = []


def class_counts(texts: list[str]) -> np.ndarray:
    """Characters of each class, a row per text."""
    if not _CLASS:
        _CLASS.append(_classes())
    out = np.zeros((len(texts), N_CLASSES), dtype=np.int64)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i] = np.bincount(_CLASS[0][np.minimum(codes, 65535)], minlength=N_CLASSES)
    return out


def repeated_words(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(words, words inside windows of so many words that the text has twice or more)."""
    words = Words(texts)
    n = np.diff(words.first)
    at = words.starts(run)
    change = np.zeros(words.n + 1, dtype=np.int64)
    if len(at):
        key = words.windows(run)[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        twice = at[order[same[1:] | same[:-1]]]
        np.add.at(change, twice, 1)
        np.add.at(change, twice + run, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    return n, inside[words.first[1:]] - inside[words.first[:-1]]


def base_failed(n: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    return (n < LEAST) | (100 * repeated > MOST_REPEATED * n)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """language -> (class shares, place of each common word, word shares, the last for all others).

    The sums run over all documents; what comes to the driver is bounded by the number of
    languages: ``COMMON`` words and a few sums for each.
    """
    prepare(docs.sparkSession)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(g, w, n) for g, c in words.items() for w, n in c.items() if w[:2] == "  " or any(map(str.isalpha, w))]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["lang", "item", "n"])

        for batch in them:
            texts, langs = ([x or y for x in batch.column(i).to_pylist()] for i, y in ((0, ""), (1, None)))
            counts = class_counts(texts)
            good = [~base_failed(*repeated_words(part)) for part, _ in batches(texts, np.arange(len(texts)))]
            for i, (text, lang, ok) in enumerate(zip(texts, langs, np.concatenate(good).tolist(), strict=True)):
                if not ok:
                    continue
                mine = words.setdefault(lang, Counter())
                tokens = text.lower().split()
                mine.update(tokens)
                mine["  all"] += len(tokens)
                for k in range(N_CLASSES):
                    mine[f"  {k}"] += int(counts[i, k])
            if sum(map(len, words.values())) > 200_000:
                yield flush()
        yield flush()

    totals = settle(docs.select("text", "lang").mapInArrow(without_gc(run), "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    facts: dict[str | None, Counter] = {}
    for r in totals.where(F.col("item").startswith("  ")).collect():
        facts.setdefault(r["lang"], Counter())[r["item"].strip()] = r["n"]
    pooled = sum(facts.values(), Counter())
    total = pooled["all"]
    words = totals.where(~F.col("item").startswith("  "))
    everywhere = {r["item"]: r["n"] for r in words.groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(COMMON).collect()}
    if not everywhere:
        return {}
    weighed = words.withColumn("weight", F.col("n") + F.sum("n").over(Window.partitionBy("item")) * PRIOR / F.lit(total))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "item"))
    weights: dict[str | None, dict[str, float]] = {k: {w: n * PRIOR / total for w, n in everywhere.items()} for k in facts}
    for chosen in (weighed.withColumn("place", place).where(F.col("place") <= COMMON), weighed.where(F.col("item").isin(list(everywhere)))):
        for r in chosen.select("lang", "item", "weight").collect():
            weights[r["lang"]][r["item"]] = r["weight"]
    out: dict[str | None, tuple] = {}
    for lang, sums in facts.items():
        classes = np.array([sums[str(k)] + PRIOR * pooled[str(k)] / total for k in range(N_CLASSES)], dtype=float)
        best = dict(sorted(weights[lang].items(), key=lambda x: (-x[1], x[0]))[:COMMON])
        index = {w: i for i, w in enumerate(sorted(best))}
        shares = np.array([best[w] for w in index] + [max(0.0, sums["all"] + PRIOR - sum(best.values()))], dtype=float)
        out[lang] = (classes / classes.sum(), index, shares / shares.sum())
    return {k: v for k, v in out.items() if k is not None} or out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p from q: 0 equal, 1 disjoint."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The counts and verdict of each document; with ``carry`` its row as well, as struct ``row``."""
    known = references(docs)
    limits = np.array([min(WORD_LIMIT, WORD_SHARE * _without(shares)) for _, _, shares in known.values()])

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k.split()[0]: [] for k in OUT.split(", ")} | {"doc_id": rows["doc_id"]}
        if carry:
            out["row"] = rows["row"]
        for texts, _ in batches([t or "" for t in rows["text"]], np.arange(len(rows["text"]))):
            classes = class_counts(texts)
            n, repeated = repeated_words(texts)
            chars = classes.sum(axis=1)
            failed = base_failed(n, repeated)
            shares = classes / np.maximum(chars, 1)[:, None]
            by_class = np.array([divergence(shares, q) for q, _, _ in known.values()]).reshape(len(known), len(texts))
            by_word = np.array([_word_distances(t, known) if n[i] >= LEAST_WORDS else [0.0] * len(known) for i, t in enumerate(texts)]).reshape(len(texts), len(known)).T
            accepted = ((chars < LEAST_CHARS) | (by_class <= CLASS_LIMIT)) & (by_word <= limits[:, None])
            kept = ~failed & (accepted.any(axis=0) | (not known))
            nearest, nearest_words = (x.min(axis=0, initial=1.0) if known else np.zeros(len(texts)) for x in (by_class, by_word))
            for name, value in (("n_words", n), ("word_chars", chars - classes[:, 0]), ("n_symbols", classes[:, 1]), ("n_dup_lines", [duplicate_lines(t) for t in texts]), ("n_repeat_words", repeated), ("base_failed", failed), ("kept", kept), ("class_distance", nearest), ("word_distance", nearest_words)):
                out[name] += list(value)
        return out

    if not carry:
        return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), OUT, work)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    return per_batch(whole, fields(whole, ["row"], OUT), work)


def _word_distances(text: str, known: dict[str | None, tuple[np.ndarray, dict[str, int], np.ndarray]]) -> list[float]:
    """Distance of the text's words from each language."""
    counts, out = Counter(text.lower().split()), []
    total = sum(counts.values())
    for _, index, shares in known.values():
        mine = np.zeros(len(shares))
        for word, i in index.items():
            mine[i] = counts.get(word, 0)
        mine[-1] = total - mine.sum()
        out.append(float(divergence(mine / max(total, 1), shares)))
    return out


def _without(shares: np.ndarray) -> float:
    """The distance of a text that has no common word."""
    none = np.zeros(len(shares))
    none[-1] = 1
    return float(divergence(none, shares))
