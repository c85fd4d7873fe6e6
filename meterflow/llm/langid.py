"""Language identification by a string kernel.

The kernel of two texts is the share of blended-spectrum n-grams (1 to 3 characters, lower
case, presence only) that both have, over the geometric mean of their counts.  Nyström
landmarks stand for the training texts, and a one-versus-rest kernel ridge regression gives
a margin per language.  N-grams are hashed to ``DIMENSIONS`` places, so that a batch is scored
by two matrix products.

About ``TRAIN_ROWS`` labelled rows at most, and besides ``LEAST_ROWS`` of each language (all, if it has no more), are
used to fit, chosen by a hash of doc_id, and ``LANDMARKS`` of the labelled rows as landmarks; every document is
scored on its whole text.

Cases: null text or one without a letter gives ``und`` and 0; letters of all planes count; with nothing to
learn from all are ``und``; rows that repeat a doc_id are judged each on its own (a null id is not held
out); ties go to the language first in order; very long texts are read whole, until all places of
the table may be taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.base import per_batch, prepare
from meterflow.llm.toxicity import remainder

TRAIN_ROWS, LEAST_ROWS, LANDMARKS = 8000, 200, 192
DIMENSIONS = 1 << 13
RIDGE = 1e-2
#: Margins are turned into shares of a sum of powers of two of this many times the margin.
SHARPNESS = 8.0
_CHUNK = 128


def presence(texts: list[str]) -> np.ndarray:
    """0/1 rows of hashed n-grams of the texts."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        # Runs of what is not a letter become one blank, so that digits and signs say nothing.
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(_letters()[codes], codes, 32).astype(np.uint32)
        if len(codes) > 1:
            codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        h = codes
        for n in range(3):
            if n:
                h = h[:-1] * np.uint32(0x01000193) + codes[n:]
            out[i, (h * np.uint32(0x9E3779B1)) >> np.uint32(19)] = 1
    return out


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[None, :]
    return (x @ landmarks.T) / size


class LanguageModel:
    """Landmarks, weights per landmark and language, and the languages in order."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, languages: list[str]) -> None:
        self.landmarks, self.weights, self.languages = landmarks, weights, languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.languages and any(c.isalpha() for c in t)]
        for k in range(0, len(some), _CHUNK):
            at = some[k : k + _CHUNK]
            margin = kernel(presence([texts[i] or "" for i in at]), self.landmarks) @ self.weights
            share = np.exp2(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            for i, best, s in zip(at, margin.argmax(axis=1), share, strict=True):
                labels[i], scores[i] = self.languages[best], float(s[best])
        return labels, scores


def _nothing() -> LanguageModel:
    return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, 0)), [])


def fit(labelled: DataFrame) -> LanguageModel:
    """Learns from (doc_id, text, lang) rows with a language and a text."""
    prepare(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null and text <> ''").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, total = sorted(sizes), sum(sizes.values())
    if not total:
        return _nothing()
    spread = F.xxhash64(F.lit("landmark"), "doc_id").bitwiseAND(2**30 - 1) / 2**30
    limit = F.coalesce(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(LANDMARKS / len(sizes) / n))])[F.col("lang")], F.lit(0.0))
    picked = rows.where(spread < F.greatest(limit, F.lit(0.0))).orderBy(spread, "doc_id").limit(2 * LANDMARKS).select("text").collect()
    if not picked:
        picked = rows.orderBy(spread, "doc_id").limit(LANDMARKS).select("text").collect()
    landmarks = presence([r["text"] for r in picked])
    m, place = len(landmarks), {k: i for i, k in enumerate(languages)}

    def sums(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, n = np.zeros((m, m)), np.zeros((m, len(place))), 0
        for batch in them:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), _CHUNK):
                k = kernel(presence(texts[i : i + _CHUNK]), landmarks).astype(np.float64)
                y = -np.ones((len(k), len(place)))
                y[np.arange(len(k)), [place[g] for g in langs[i : i + _CHUNK]]] = 1
                gram, target, n = gram + k.T @ k, target + k.T @ y, n + len(k)
        if n:
            flat = np.concatenate([gram, target], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int64()), pa.array(list(flat))], names=["i", "v"])

    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(TRAIN_ROWS / total, LEAST_ROWS / n)))])[F.col("lang")]
    sample = rows.where(F.xxhash64(F.lit("train"), "doc_id").bitwiseAND(2**30 - 1) / 2**30 < rate)
    parts = sample.select("text", "lang").coalesce(64).mapInArrow(sums, "i long, v array<double>").select("i", F.posexplode("v")).groupBy("i", "pos").agg(F.sum("col").alias("v")).collect()
    both = np.zeros((m, m + len(languages)))
    for r in parts:
        both[r["i"], r["pos"]] = r["v"]
    inner = kernel(landmarks, landmarks).astype(np.float64)
    weights = np.linalg.solve(both[:, :m] + RIDGE * inner + 1e-6 * np.trace(both[:, :m]) / m * np.eye(m), both[:, m:])
    return LanguageModel(landmarks, weights, languages)


def identify(docs: DataFrame, held: int = 2, divisor: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that are not held out."""
    model = fit(docs.where(remainder(divisor) != held))

    def work(rows: dict[str, list]) -> dict[str, list]:
        labels, scores = model.predict(rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": labels, "score": scores}

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(divisor) == held, F.lit(False)).alias("held_out"), "text")
    return per_batch(asked, "doc_id long, held_out boolean, lang_pred string, score double", work)
