"""N-gram Jaccard join: which documents share at least ``THRESHOLD`` of their word shingles.

1. Documents of equal shingle sets (128 bits of scrambled sums of 64-bit shingle hashes) form one
   class, known by the number of one of its rows.
2. MinHash bands propose pairs of classes.  Classes that bands connect are one candidate set; if
   it has more than ``BLOCK`` classes, the pairs of each band are compared by MinHash values alone, and
   only classes that stay connected make a set.  No pair is written out.
3. Each pair inside a candidate set is judged once, in blocks, so that a large set is spread
   over many tasks: MinHash values are compared a few at a time, a pair goes as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold falls
   below ``TOLERANCE``, and what is left is verified on the whole shingle sets.
4. Verified links are summed per class and joined up to groups.

With 42 bands of 6 values a pair at exactly 0.8 is missed with probability 3e-6, one at 0.9
with 1e-14.

Cases: a text of fewer than five words has one shingle of all its words; one without words
(or null) is in no link and a group of its own; rows that repeat a doc_id count as documents
of their own, and classes never meet by doc_id; rows with a null doc_id are linked and grouped
like others, and class and group are null where all ids are; a tie for the smallest is between
equal ids and changes nothing; very long texts are read whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.base import documents, per_batch, prepare, settle, spread_join, without_gc
from meterflow.llm.components import components
from meterflow.llm.grams import Words, batches, minhash, mix, unique_shingles

SHINGLE = 5
#: Fixed value: a text with a word has a character other than these blanks.
WORD = r"[^\x20\x09-\x0D]"
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
VALUES = 256
#: MinHash values compared in one step, and the least posterior probability to go on.
STEP = 32
TOLERANCE = 1e-9
#: Classes of one block of texts; two blocks are compared in one task.  Blocks of MinHash values
#: (a byte of each) are larger.
BLOCK, SIGNS = 256, 2048


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sketch(width: int):
    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("at", "doc_id", "h", "k1", "k2", "n", "bands", "signs")}
        for texts, at in batches([t or "" for t in rows["text"]], np.arange(len(rows["text"]))):
            doc, shingle = unique_shingles(Words(texts), width)
            n = np.bincount(doc, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(n)])
            keys = []
            for salt in (1, 2):
                sums = np.zeros(len(doc) + 1, dtype=np.uint64)
                np.cumsum(mix(shingle, salt), out=sums[1:])
                keys.append(mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64)))
            values = minhash(doc, shingle, len(texts), VALUES).astype(np.uint64)
            bands = np.empty((len(texts), BANDS), dtype=np.uint64)
            for b in range(BANDS):
                key = np.full(len(texts), b, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key ^ values[:, b * ROWS + r])
                bands[:, b] = key
            for name in ("at", "doc_id", "h"):
                out[name] += [rows[name][i] for i in at]
            out["k1"] += _signed(keys[0]).tolist()
            out["k2"] += _signed(keys[1]).tolist()
            out["n"] += n.tolist()
            out["bands"] += list(_signed(bands))
            out["signs"] += [row.tobytes() for row in values.astype(np.uint8)]
        return out

    return work


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each count h of compared values, the fewest matches that keep a pair.

    With a uniform prior the posterior of the similarity is Beta(m + 1, h - m + 1), whose tail
    above t equals the probability of at most m successes among h + 1 trials of chance t.
    """
    out = {}
    for h in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[h] = m
    return out


def likely_pairs(values: np.ndarray, block: list[int], least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that stay likely: inside the block if there is one, across the two if there are two."""
    side = np.asarray(block)
    first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
    a, b = [first[:0]], [first[:0]]
    for k, i in enumerate(first):
        other = second if len(second) else first[k + 1 :]
        matches = np.zeros(len(other), dtype=np.int64)
        for h in range(0, VALUES, STEP):
            if not len(other):
                break
            matches = matches + (values[other, h : h + STEP] == values[i, h : h + STEP]).sum(axis=1)
            keep = matches >= least[h + STEP]
            other, matches = other[keep], matches[keep]
        a.append(np.full(len(other), i))
        b.append(other)
    return np.concatenate(a), np.concatenate(b)


def verified_pairs(texts: list[str], block: list[int], width: int, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs of texts whose whole shingle sets reach the threshold."""
    doc, shingle = unique_shingles(Words(texts), width)
    a, b = likely_pairs(minhash(doc, shingle, len(texts), VALUES), block, least)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [shingle[cut[i] : cut[i + 1]] for i in range(len(texts))]
    good = np.zeros(len(a), dtype=bool)
    for k, (i, j) in enumerate(zip(a, b, strict=True)):
        x, y = sets[i], sets[j]
        if len(x) > len(y):
            x, y = y, x
        if len(x) < threshold * len(y):
            continue
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        good[k] = common >= threshold * (len(x) + len(y) - common) - 1e-9
    return a[good], b[good]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is linked with, through any others."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _by_group(one, names: tuple[str, ...]):
    """mapInArrow over rows sorted by their first column: ``one`` gets the rows of each value that has two or more."""
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        for batch in them:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if len(group) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one(group)], schema=schema)
                    group, now = [], row[0]
                group.append(row)
        if len(group) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one(group)], schema=schema)

    return without_gc(run)


def _judge(width: int, threshold: float):
    least = least_matches(threshold, TOLERANCE)

    def one(group: list[tuple]) -> tuple[list, list, list]:
        nodes = [g[1] for g in group]
        a, b = verified_pairs([g[4] or "" for g in group], [g[2] for g in group], width, threshold, least)
        links = np.zeros(len(group), dtype=np.int64)
        copies = np.asarray([g[3] for g in group], dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root, linked = _roots(len(group), a, b), np.flatnonzero(links)
        return [nodes[i] for i in linked], links[linked].tolist(), [nodes[root[i]] for i in linked]

    return _by_group(one, ("node", "links", "root"))


def _connect(threshold: float):
    least = least_matches(threshold, TOLERANCE)

    def one(group: list[tuple]) -> tuple[list, list]:
        values = np.frombuffer(b"".join(g[3] for g in group), dtype=np.uint8).reshape(len(group), VALUES)
        a, b = likely_pairs(values, [g[2] for g in group], least)
        root = _roots(len(group), a, b)
        moved = np.flatnonzero(root != np.arange(len(group)))
        return [group[i][1] for i in moved], [group[root[i]][1] for i in moved]

    return _by_group(one, ("node", "low"))


def in_blocks(members: DataFrame, group: str, size: int, *more: str) -> DataFrame:
    """(key, node, block, more): each member once for each pair of blocks of its group that has its block.

    Rows of one key are next to each other; a key holds about 2 * size members at most.
    """
    blocks = members.groupBy(group).agg(F.count("*").alias("n")).select(group, F.ceil(F.col("n") / size).cast("int").alias("blocks"), "n")
    placed = spread_join(members, settle(blocks.where("n > 1")), [group], "n").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = pairs.select(F.concat_ws(",", group, F.least("block", "with"), F.greatest("block", "with")).alias("key"), "node", "block", *more)
    return keyed.repartition("key").sortWithinPartitions("key", "node")


def candidate_sets(bands: DataFrame, signs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component): classes in one set if bands, and in large sets likely pairs of bands, connect them."""
    lowest = settle(bands.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1"))
    near = spread_join(bands, lowest, ["band"], "n").where("node > low").select("low", "node").distinct()
    sets = settle(components(near, "low", "node"))
    sizes = settle(sets.groupBy("component").agg(F.count("*").alias("n")))
    sized = settle(spread_join(sets, sizes.withColumn("large", F.col("n") > BLOCK), ["component"], "n"))
    wide = sized.where("large")
    if wide.isEmpty():
        return sets
    members = settle(bands.join(wide.select("node"), "node").join(signs, "node"))
    likely = settle(in_blocks(members, "band", SIGNS, "signs").mapInArrow(_connect(threshold), "node long, low long"))
    return settle(sized.where("not large").select("node", "component").union(components(likely, "low", "node").select("node", "component")))


def row_key() -> list[F.Column]:
    """(id0, h), equal for rows of equal doc_id and text, nulls included."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id0"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h")]


def grouped(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """similar_groups with (id0, h) of each row, its words' presence, and the number of its group."""
    texts = documents(docs).select("doc_id", "text", *row_key())
    numbered = texts.select(F.monotonically_increasing_id().alias("at"), "doc_id", "h", "text")
    sketch = settle(per_batch(numbered, "at long, doc_id long, h long, k1 long, k2 long, n long, bands array<long>, signs binary", _sketch(width)))
    classes = settle(sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("at").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    heads = sketch.withColumnRenamed("at", "node").join(classes.select("node", "copies"), "node")
    bands = settle(heads.select("node", F.explode("bands").alias("band")).distinct())
    sets = candidate_sets(bands, sketch.select(F.col("at").alias("node"), "signs"), threshold)
    members = sets.join(heads.select("node", F.coalesce("doc_id", F.lit(0)).alias("id0"), "h", "copies"), "node")
    # One row of equal ones, before they meet anything.
    one_text = texts.groupBy("id0", "h").agg(F.min("text").alias("text"))
    loaded = settle(members.join(one_text, ["id0", "h"]).select("node", "component", "copies", "text"))
    judged = settle(in_blocks(loaded, "component", BLOCK, "copies", "text").mapInArrow(_judge(width, threshold), "node long, links long, root long"))
    found = components(judged, "node", "root")
    least = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("n"))
    groups = spread_join(settle(found), settle(least), ["component"], "n")
    totals = judged.groupBy("node").agg(F.sum("links").alias("links"))
    known = settle(classes.join(totals, "node", "left").join(groups, "node", "left").withColumn("n_copies", F.col("copies")))
    rows = sketch.select("at", "doc_id", "h", "k1", "k2", "n")
    wordless = rows.where("n = 0").drop("k1", "k2")
    placed = spread_join(rows.where("n > 0"), known, ["k1", "k2"], "copies").drop("k1", "k2")
    return placed.unionByName(wordless, allowMissingColumns=True).select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("low", "rep", "doc_id").alias("group_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id0"),
        "h",
        (F.col("n") > 0).alias("worded"),
        F.coalesce("component", "node", "at").alias("group"),
    )


def similar_groups(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, group_id) for each document.

    class_id: the smallest doc_id with the same shingles.  n_links: how many other documents
    are at least as similar as the threshold, copies included.  group_id: the smallest doc_id
    reachable over such links.
    """
    return grouped(docs, width, threshold).select("doc_id", "class_id", "n_links", "group_id")


def firsts(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns: of its smallest doc_id (null if it has no other).

    Rows of that id in the group differ by their text's hash, equal ones by that of the whole row;
    rows without words are groups of their own and all stay.
    """
    prepare(docs.sparkSession)
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = grouped(docs).where(F.col("worded") & F.col("doc_id").eqNullSafe(F.col("group_id")))
    chosen = rows.groupBy("group").agg(F.min("id0").alias("id0"), F.min("h").alias("h")).select("id0", "h").distinct()
    # Equal rows become one before they meet anything.
    keyed = docs.where(worded).select(F.struct(*docs.columns).alias("row"), *row_key(), F.xxhash64(*docs.columns).alias("whole"))
    one = keyed.groupBy("id0", "h").agg(F.min_by("row", "whole").alias("row")).join(chosen, ["id0", "h"]).select("row.*")
    return one.unionByName(docs.where(~worded))
