"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. Near copies among the labelled texts (equal least hash of their five-word shingles) teach once.
   The rest fall into ``FOLDS`` parts by that hash.
2. The lexicon holds words and word starts that more toxic documents have than others, once or
   at least twice, by the log-likelihood ratio.  Each part sees the ratios of the other parts, so
   that every label teaches the lexicon and no document meets its own words.
3. Features are densities and strengths of lexicon hits, their nearness to second-person words,
   capitals, punctuation and obfuscation rates.  Trees learn from most of the labelled texts, the
   rest calibrate them, summed up per margin.

Only labelled texts of the learning part are used to fit; every document is scored.

Cases: null or empty text has all features zero and is scored like others; without a lexicon the
trees learn from the other features; with labels of one class only the score is that class, without
any it is 0; labels that repeat a doc_id count as often as they come, a null label never; rows
that repeat a doc_id, also a null one, are scored each on its own (a null id is not held out and has no
label); equal texts have equal scores; very long texts are read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable
from functools import partial
from typing import Any

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.base import fields, kept, packed, per_batch, plain, prepare, settle
from meterflow.llm.grams import Words, batches, mix, unique_shingles

#: At most so many lexicon entries are kept for a part, those of the highest ratio; each must be in so
#: many toxic documents and reach such a ratio.
LEXICON, SUPPORT, LEAST = 4096, 2, 6.0
#: Lengths of word starts, parts of the labelled texts, and strengths at which hits are counted.
STEMS, FOLDS, LEVELS = (4, 6), 4, (6.0, 12.0, 24.0, 48.0)
NEAR = 6
THRESHOLD = 0.7
#: Tenths of the labelled texts that teach the trees; the others calibrate.
TREES = 7
#: Second-person words of the supported languages.
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro".split())
#: Letters that signs and digits stand for.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>«»…-–—*#%&|"
FEATURES = (
    *(f"{k}_{int(level)}" for level in LEVELS for k in ("hits", "kinds", "density")), "best", "second", "third", "twice", "twice_again",
    "hidden", "near_you", "you", "capitals", "loud", "exclaim", "punctuation", "obfuscated", "length", "stretched",
)
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_PUNCT = np.zeros(256)
_PUNCT[[ord(c) for c in "!?.,;:*#$%&|<>@"]] = 1
_LETTER = np.zeros(256)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(65, 91), *range(97, 123)]] = True


def normal(token: str) -> tuple[str, str]:
    """(plain, unmasked) lower-case forms: edges stripped; then look-alikes and inner signs undone."""
    core = token.strip(_EDGE).lower()
    if core.isalpha():
        return core, core
    bare = "".join(_WORD.findall(core.translate(LOOKALIKE))) if any(c.isalpha() for c in core) else ""
    return core, bare


def entries(token: str) -> list[str]:
    """Lexicon entries that a token stands for: its plain word, and starts of longer ones."""
    return _entries(normal(token)[1])


def _entries(word: str) -> list[str]:
    return ["w" + word, *("s" + word[:k] for k in STEMS if len(word) > k)] if len(word) >= 2 else []


def _keys(rows: dict[str, list]) -> dict[str, list]:
    """The least hash of each text's five-word shingles; texts without words share one."""
    key = np.full(len(rows["packed"]), -1, dtype=np.int64)
    for texts, at in batches([plain(p) for p in rows["packed"]], np.arange(len(rows["packed"]))):
        doc, shingle = unique_shingles(Words(texts), 5)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, doc, mix(shingle, 5).view(np.int64))
        key[at] = least
    return rows | {"key": key}


def _counted(rows: dict[str, list]) -> dict[str, list]:
    """Documents of a batch with each entry, once and (marked 2) at least twice, by part and label."""
    known: dict[str, list[str]] = {}
    sums: dict[tuple[str, int, int], int] = {}
    for text, toxic, fold in zip(map(plain, rows["packed"]), rows["toxic"], rows["fold"], strict=True):
        found: dict[str, int] = {}
        for token, n in Counter(text.split()).items():
            if token not in known:
                known[token] = entries(token)
            for e in known[token]:
                found[e] = found.get(e, 0) + n
        for e, n in found.items():
            sums[e, fold, toxic] = sums.get((e, fold, toxic), 0) + 1
            if n > 1:
                e = "2" + e
                sums[e, fold, toxic] = sums.get((e, fold, toxic), 0) + 1
    keys = list(sums)
    return {"entry": [k[0] for k in keys], "fold": [k[1] for k in keys], "toxic": [k[2] for k in keys], "n": list(sums.values())}


def _ratio(a: Column, b: Column, a_all: float, b_all: float) -> Column:
    """Log-likelihood ratio of a of a_all toxic and b of b_all other documents; 0 unless the toxic have more."""

    def part(x: Column, n: float, p: Column) -> Column:  # x of n at the rate p, against its own rate
        own = x / n
        return F.when(x > 0, x * F.log(own / p)).otherwise(0.0) + F.when(x < n, (n - x) * F.log((1 - own) / (1 - p))).otherwise(0.0)

    rate = F.least(F.lit(1 - 1e-9), (a + b) / (a_all + b_all))
    return F.when((a >= SUPPORT) & (a / a_all > b / b_all), 2 * (part(a, a_all, rate) + part(b, b_all, rate))).otherwise(0.0)


def learn_lexicon(known: DataFrame) -> list[dict[str, float]]:
    """entry -> ratio, for each part (learnt from the other parts) and, last, from all; each bounded by LEXICON."""
    totals = {(r["fold"], r["toxic"]): float(r["n"]) for r in known.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = per_batch(known.select("packed", "toxic", "fold"), "entry string, fold int, toxic int, n long", _counted)
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]
    ratios = []
    for left_out in [*range(FOLDS), None]:
        parts = [f for f in range(FOLDS) if f != left_out]
        a, b = (sum((F.col(f"n{f}_{t}") for f in parts), F.lit(0)) for t in (1, 0))
        a_all, b_all = (sum(totals.get((f, t), 0.0) for f in parts) for t in (1, 0))
        ratios.append((_ratio(a, b, a_all, b_all) if a_all and b_all else F.lit(0.0)).alias(f"g{len(ratios)}"))
    names = [f"g{i}" for i in range(FOLDS + 1)]
    scored = counts.groupBy("entry").agg(*sums).select("entry", *ratios).where(F.greatest(*names) >= LEAST)
    best = settle(scored)
    out = []
    for g in names:
        rows = best.where(F.col(g) >= LEAST).orderBy(F.desc(g), "entry").limit(LEXICON).select("entry", g).collect()
        out.append({r[0]: float(r[1]) for r in rows})
    return out


class _Known(dict):
    """What is known of tokens; asks for what is not."""

    def __init__(self, ask: Callable[[str], int]) -> None:
        self.ask = ask

    def __missing__(self, token: str) -> int:
        self[token] = found = self.ask(token)
        return found


class Featurizer:
    """Features of a text, by one lexicon; keeps what it knows of recent tokens."""

    KEEP = 300_000

    def __init__(self, lexicon: dict[str, float], keep: int = KEEP) -> None:
        self.lexicon, self.keep = lexicon, keep
        names = {e.removeprefix("2") for e in lexicon}
        self.words = {e[1:] for e in names if e[0] == "w"} | SECOND_PERSON
        self.starts = [{e[1:] for e in names if e[0] == "s" and len(e) == k + 1} for k in STEMS]
        twice = [e for e in lexicon if e[0] == "2"]
        self.twice = {e[1:]: i + 1 for i, e in enumerate(twice)}
        self.twice_ratio = np.array([0.0, *(lexicon[e] for e in twice)])
        self.entry = {e: i + 1 for i, e in enumerate(sorted(names))}
        #: token -> place in the arrays of facts; place 0, as for most tokens, says nothing.
        self.seen = _Known(self.about)
        #: What a token shows of the lexicon and its signs -> the same place; as many as the lexicon has.
        self.places: dict[tuple, int] = {}
        self.signs, self.best = np.zeros(1024, dtype=np.uint8), np.zeros(1024)
        self.which, self.again = np.zeros(1024, dtype=np.int64), np.zeros((1024, 1 + len(STEMS)), dtype=np.int64)

    def about(self, token: str) -> int:
        """Where the facts of a token are: signs, ratio and number of its best entry, entries that count twice.

        Signs: 1 found only once unmasked, 2 second person, 4 all capitals, 8 masked.
        """
        plain, bare = normal(token)
        n = len(bare)
        shown = (bare if bare in self.words else "", *[bare[:k] if n > k and bare[:k] in held else "" for k, held in zip(STEMS, self.starts, strict=True)])
        loud = len(plain) >= 3 and token.isupper()
        masked = plain is not bare and plain != bare and bool(bare and plain)
        if not loud and not masked and not any(shown):
            return 0
        key = (*shown, loud, masked)
        if key not in self.places:
            found = [e for e in ("w" + shown[0], *("s" + x for x in shown[1:] if x)) if e in self.entry]
            best = max(found, key=lambda e: self.lexicon.get(e, 0.0), default="")
            ratio = self.lexicon.get(best, 0.0)
            at = len(self.places) + 1
            if at == len(self.best):
                self.signs, self.best, self.which, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.signs, self.best, self.which, self.again))
            self.signs[at] = 1 * (masked and ratio > 0) | 2 * (plain in SECOND_PERSON) | 4 * loud | 8 * masked
            self.best[at], self.which[at] = ratio, self.entry.get(best, 0)
            again = [self.twice[e] for e in found if e in self.twice]
            self.again[at, : len(again)] = again
            self.places[key] = at
        return self.places[key]

    def of(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(FEATURES)
        if len(self.seen) >= self.keep:
            self.seen.clear()
        n = len(tokens)
        codes = np.fromiter(map(self.seen.__getitem__, tokens), dtype=np.int64, count=n)
        some = np.flatnonzero(codes)
        codes = codes[some]
        signs, best = self.signs[codes], self.best[codes]
        hit, you = some[best > 0], some[(signs & 2) > 0]
        _, at = np.unique(self.which[codes[best > 0]], return_index=True)
        best = best[best > 0]
        kinds = np.sort(best[at])[::-1]
        counts = np.bincount(self.again[codes].ravel(), minlength=2) if len(codes) else np.zeros(2)
        again = np.sort(self.twice_ratio[1 + np.flatnonzero(counts[1:] > 1)])[::-1] if len(self.twice) else kinds[:0]
        near = 0
        if len(hit) and len(you):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(you[np.maximum(at - 1, 0)] - hit))
            near = int((gap <= NEAR).sum())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        bytes_ = np.bincount(raw, minlength=256)
        size = len(raw)
        out = []
        for level in LEVELS:
            hits = int((best >= level).sum())
            out += [float(np.log1p(hits)), float(np.log1p((kinds >= level).sum())), hits / n]
        tops = np.zeros(5)
        tops[: len(kinds[:3])] = kinds[:3]
        tops[3 : 3 + len(again[:2])] = again[:2]
        return [
            *out, *np.log1p(tops).tolist(),
            int((signs & 1 > 0).sum()) / n, near / n, len(you) / n, float(bytes_ @ _UPPER) / max(1.0, float(bytes_ @ _LETTER)),
            int((signs & 4 > 0).sum()) / n, float(bytes_[33]) / size, float(bytes_ @ _PUNCT) / size, int((signs & 8 > 0).sum()) / n, float(np.log1p(n)),
            _stretched(raw) / n,
        ]


def _stretched(codes: np.ndarray) -> int:
    """Runs of four or more equal letters from a to z."""
    same = codes[1:] == codes[:-1]
    three = same[2:] & same[1:-1] & same[:-2]
    at = np.flatnonzero(three)
    at = at[_PLAIN[codes[at]]]
    return int(len(at) and 1 + (np.diff(at) > 1).sum())


def features(df: DataFrame, lexicons: list[dict[str, float]], keep: str, fold: str | None = None) -> DataFrame:
    """The named columns of df and ``x``, the features of its text (or packed text) by the lexicon of its part, or the last one."""
    mine = uuid.uuid4().hex
    names = keep.split(", ")
    source = "packed" if "packed" in df.columns else "text"

    def work(rows: dict[str, list]) -> dict[str, list]:
        which = rows[fold] if fold else [-1] * len(rows[source])
        made = {k: kept(mine, k, partial(Featurizer, lexicons[k], Featurizer.KEEP // len(lexicons))) for k in set(which)}
        texts = map(plain, rows[source]) if source == "packed" else rows[source]
        return {n: rows[n] for n in names} | {"x": [made[k].of(t) for k, t in zip(which, texts, strict=True)]}

    lexicons = lexicons if fold else lexicons[-1:]
    return per_batch(df.select(*names, source), fields(df, names, "x array<double>"), work)


class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` if there was nothing to learn from."""

    def __init__(self, lexicons: list[dict[str, float]], trees: Any, calibration: Any, constant: float) -> None:
        self.lexicons, self.trees, self.calibration, self.constant = lexicons, trees, calibration, constant

    def score(self, df: DataFrame, keep: str) -> DataFrame:
        """The named columns and ``score``; one pass over the texts."""
        names = keep.split(", ")
        if self.trees is None:
            return df.select(*names, F.lit(float(self.constant)).alias("score"))
        raw = _margin(self.trees, features(df, self.lexicons, keep))
        return self.calibration.transform(raw).select(*names, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def _margin(trees: Any, df: DataFrame) -> DataFrame:
    return trees.transform(df.withColumn("features", array_to_vector("x"))).withColumn("margin", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "x")


def fit(labelled: DataFrame) -> ToxicityModel:
    """Learns from (packed text, toxic) rows."""
    prepare(labelled.sparkSession)
    labelled = labelled.where("toxic is not null").select("packed", F.col("toxic").cast("int").alias("toxic"))
    keyed = per_batch(labelled, fields(labelled, ["packed", "toxic"], "key long"), _keys)
    once = keyed.groupBy("key", "toxic").agg(F.min("packed").alias("packed"))
    known = settle(once.select("packed", "toxic", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold"), F.pmod(F.xxhash64("key", F.lit("use")), F.lit(10)).alias("use")))
    n, toxic, tree_n, tree_toxic, iso_n = known.agg(F.count("*"), F.sum("toxic"), F.count_if(F.col("use") < TREES), F.sum(F.when(F.col("use") < TREES, F.col("toxic"))), F.count_if(F.col("use") >= TREES)).first()
    if not tree_toxic or tree_toxic == tree_n or not iso_n:
        return ToxicityModel([], None, None, (toxic or 0) / n if n else 0.0)
    lexicons = learn_lexicon(known)
    seen = settle(features(known, lexicons, "toxic, fold, use", "fold"))
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.3, maxBins=32, minInstancesPerNode=2, seed=7)
    learnt = trees.fit(seen.where(F.col("use") < TREES).withColumn("features", array_to_vector("x")).select("toxic", "features"))
    # Many documents share a margin: one row for each.
    margins = _margin(learnt, seen.where(F.col("use") >= TREES)).groupBy("margin").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"), F.count("*").cast("double").alias("weight"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="margin", weightCol="weight", predictionCol="score").fit(margins)
    return ToxicityModel(lexicons, learnt, calibration, 0.0)


def remainder(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo the divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on documents outside the held-out third."""
    texts = packed(docs.select("doc_id", "text").where(remainder(3) != 1), "doc_id")
    # Labels grow with the documents: the same plan at every size, without a broadcast.
    return fit(texts.join(labels.select("doc_id", "toxic").where("toxic is not null").hint("merge"), "doc_id").select("packed", "toxic"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = learn(docs, labels)
    held = docs.select("doc_id", "text", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    return model.score(held, "doc_id, held_out").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
