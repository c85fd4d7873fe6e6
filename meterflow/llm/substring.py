"""Substring dedup on a de Bruijn graph of words.

1. An edge of the graph is a window of ``WINDOW`` consecutive words.  While a document is read,
   consecutive edges of one minimiser (the least hash of the shorter windows inside) become one step.
   Joins on the minimiser keep steps that two documents share; where the steps of a minimiser
   differ, the graph branches inside, and they are cut again by longer minimisers, at last into edges.
2. Compaction: a join of each step with its successor in the document, counted over all
   occurrences, tells where the graph does not branch: every occurrence of one step is followed by
   the other, and has it before.  Such steps, next to each other in the document of their first
   occurrence, are one path, and an occurrence of its first step stands for all of it.
3. Source coordinates (document, first word) of the first occurrence verify a path: a digest of
   the source's own words travels to the other occurrences, and words go only if theirs are equal.

Cases: null or empty text has no words and loses none; a null doc_id is neither a source nor
later than one; rows that repeat a doc_id are judged each on its own text, and are not
earlier than each other; equal rows lose the same words; a text of fewer words than a window
loses none, very long texts are read whole; an empty table gives no rows; other columns are carried
in ``row``, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from itertools import compress

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.base import documents, fields, packed, per_batch, plain, prepare, settle, spread_join, text_hash
from meterflow.llm.grams import Words, batches, mix, sliding_min

WINDOW = 50
#: Words of the inner windows whose least hash is the minimiser; what branches is cut by the next.
INNER = (25, 44)


def _plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _runs(words: Words, begin: np.ndarray, window: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, hash, first word, windows) of each step of the windows that begin at the given words."""
    least = sliding_min(mix(words.windows(inner), 7), window - inner + 1)[begin]
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1)])
    fresh = np.flatnonzero(fresh) if inner < window else np.arange(len(begin))
    count = np.diff(np.concatenate([fresh, [len(begin)]]))
    place = np.arange(len(begin)) - np.repeat(fresh, count)
    edges = mix(words.windows(window)[begin] + mix(place.astype(np.uint64), 8), 9)
    return least[fresh], np.add.reduceat(edges, fresh), begin[fresh], count


def _steps(window: int, inner: int):
    """Steps of whole texts, or of the given spans of packed ones."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out = {k: [] for k in ("m", "h", "doc_id", "loc", "n")}
        spans = rows.get("spans")
        ids, th = (np.asarray(rows[k], dtype=np.int64) for k in ("doc_id", "th"))
        for texts, at in batches(rows["text"] if spans is None else [plain(x) for x in rows["packed"]], np.arange(len(ids))):
            words = Words(texts)
            begin = words.starts(window)
            if spans is not None:
                change = np.zeros(words.n + 1, dtype=np.int64)
                for first, i in zip(words.first, at, strict=False):
                    np.add.at(change, [first + p["lo"] for p in spans[i]], 1)
                    np.add.at(change, [first + p["lo"] + p["n"] for p in spans[i]], -1)
                begin = begin[np.cumsum(change)[begin] > 0]
            if not len(begin):
                continue
            m, h, lo, n = _runs(words, begin, window, inner)
            doc = words.doc[lo]
            where = th[at][doc] << 32 | (lo - words.first[doc])
            for name, column in (("m", m.view(np.int64)), ("h", h.view(np.int64)), ("doc_id", ids[at][doc]), ("loc", where), ("n", n.astype(np.int64))):
                out[name].append(column)
        return {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return work


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _sources(rows: dict[str, list]) -> dict[str, list]:
    """A digest of the words of each path, at its source."""
    out = {k: [] for k in ("m", "h", "proof")}
    for data, paths in zip(rows["packed"], rows["paths"], strict=True):
        words = _plain(data).split()
        for p in paths:
            for k, v in (("m", p["m"]), ("h", p["h"]), ("proof", _digest(words[p["lo"] : p["lo"] + p["len"]]))):
                out[k].append(v)
    return out


def _cut(rows: dict[str, list]) -> dict[str, list]:
    out = {k: [] for k in ("row", "doc_id", "n_words", "n_removed", "kept")}
    for row, doc_id, data, spans in zip(rows["row"], rows["doc_id"], rows["packed"], rows["spans"], strict=True):
        words = _plain(data).split()
        n = len(words)
        if spans:
            good = [s for s in spans if _digest(words[s["lo"] : s["lo"] + s["len"]]) == s["proof"]]
            change = np.zeros(n + 1, dtype=np.int64)
            np.add.at(change, [s["lo"] for s in good], 1)
            np.add.at(change, [s["lo"] + s["len"] for s in good], -1)
            words = list(compress(words, np.cumsum(change)[:n] == 0))
        for k, v in (("row", row), ("doc_id", doc_id), ("n_words", n), ("n_removed", n - len(words)), ("kept", b" ".join(words).decode("utf-8", "surrogatepass"))):
            out[k].append(v)
    return out


def shared_steps(texts: DataFrame, squeezed: DataFrame, window: int, inner: tuple[int, ...]) -> DataFrame:
    """(m, h, doc_id, loc, n): each occurrence of a step, a run of n windows, that two documents have.

    ``loc`` is the text's hash and the first word's place in one number.
    """
    schema = "m long, h long, doc_id long, loc long, n long"
    lo, th = F.col("loc").bitwiseAND(2**32 - 1), F.shiftright("loc", 32)
    rows, done = per_batch(texts, schema, _steps(window, inner[0])), []
    for level in (*inner[1:], window, None):
        steps = settle(rows)
        met = steps.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c"))
        found = settle(spread_join(steps, settle(met.where("low < high").select("m", "c")), ["m"], "c"))
        if level is None:  # single edges, which do not branch
            return reduce(DataFrame.unionByName, [*done, found.distinct()])
        distinct = settle(found.groupBy("m", "h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c")))
        forks = settle(distinct.groupBy("m").agg(F.count("*").alias("k"), (F.count("*") > 1).alias("branches")))
        known = settle(spread_join(distinct, forks, ["m"], "k").where("branches or low < high").select("m", "h", "branches", "c"))
        placed = settle(spread_join(found, known, ["m", "h"], "c"))
        done.append(placed.where("not branches").drop("branches").distinct())
        inside = placed.where("branches").groupBy("doc_id", th.alias("th")).agg(F.collect_set(F.struct(lo.alias("lo"), "n")).alias("spans"))
        rows = per_batch(squeezed.join(inside, ["doc_id", "th"]), schema, _steps(window, level))
    raise AssertionError


def compacted(steps: DataFrame) -> DataFrame:
    """(m, h, c, doc_id, loc, n): the first step of each nonbranching path, how often it occurs, its source, its windows."""
    after = steps.select("doc_id", F.col("loc").alias("end"), F.struct("m", "h").alias("next"))
    linked = steps.withColumn("end", F.col("loc") + F.col("n")).join(after, ["doc_id", "end"], "left")
    nodes = settle(
        linked.groupBy("m", "h").agg(
            F.min(F.struct("doc_id", "loc")).alias("source"), F.max("n").alias("n"), F.count("*").alias("c"), F.count("next").alias("followed"), F.min("next").alias("next"), F.max("next").alias("last")
        )
    )
    # All occurrences of a step are followed by the same one; of the steps before that one only the most
    # frequent can be before all its occurrences.
    single = nodes.where((F.col("c") == F.col("followed")) & (F.col("next") == F.col("last"))).groupBy("next").agg(F.max("c").alias("c"))
    inner = single.select("next.m", "next.h", "c").join(nodes.select("m", "h", "c"), ["m", "h", "c"]).select("m", "h", F.lit(0).alias("starts"))
    place = Window.partitionBy("doc_id", F.shiftright("loc", 32)).orderBy("loc")
    rows = nodes.join(inner, ["m", "h"], "left").select("m", "h", "c", "n", "source.*", F.coalesce("starts", F.lit(1)).alias("starts"))
    numbered = rows.withColumn("path", F.sum("starts").over(place))
    first = F.min_by(F.struct("m", "h", "c", "loc"), "loc").alias("first")
    return numbered.groupBy("doc_id", F.shiftright("loc", 32).alias("th"), "path").agg(first, F.sum("n").alias("n")).select("first.*", "doc_id", "th", "n")


def repeated_spans(texts: DataFrame, squeezed: DataFrame, window: int = WINDOW, inner: tuple[int, ...] = INNER) -> DataFrame:
    """(doc_id, th, lo, len, proof): words of a document that an earlier one should have too."""
    steps = settle(shared_steps(texts, squeezed, window, inner))
    paths = settle(compacted(steps))
    lo, length = F.col("loc").bitwiseAND(2**32 - 1), F.col("n") + window - 1
    asked = paths.groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "h", lo.alias("lo"), length.alias("len"))).alias("paths"))
    proofs = per_batch(squeezed.join(asked, ["doc_id", "th"]), "m long, h long, proof binary", _sources).groupBy("m", "h").agg(F.min("proof").alias("proof"))
    known = settle(paths.join(proofs, ["m", "h"]).select("m", "h", "c", F.col("doc_id").alias("source"), length.alias("len"), "proof"))
    spans = spread_join(steps.drop("n"), known, ["m", "h"], "c").where("source < doc_id")
    return spans.select("doc_id", F.shiftright("loc", 32).alias("th"), lo.alias("lo"), "len", "proof")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, inner: tuple[int, ...] = INNER) -> DataFrame:
    """(row, doc_id, n_words, n_removed, kept): each document without its repeated words.

    ``row`` holds the document's other columns, as they came.
    """
    prepare(docs.sparkSession)
    texts = documents(docs).where("doc_id is not null and text is not null").withColumn("th", text_hash())
    some = packed(texts, "doc_id", "th")
    spans = settle(repeated_spans(texts, some, window, inner).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "len", "proof")).alias("spans")))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row")).withColumn("th", text_hash())
    joined = packed(whole, "row", "doc_id", "th").join(spans, ["doc_id", "th"], "left").select("row", "doc_id", "packed", "spans")
    return per_batch(joined, fields(joined, ["row"], "doc_id long, n_words long, n_removed long, kept string"), _cut)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
