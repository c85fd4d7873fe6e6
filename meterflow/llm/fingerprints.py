"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text, cut further after sentence ends, and where it is long or the text
short at places that its letters tell) is hashed to a wide vector:
``UNIFORM`` words of 32 bits and ``SIGNED`` lanes of plus or minus one.  A document's fingerprint is
the sum of its paragraphs' vectors modulo 2**32 and 2**16, so that the order of paragraphs does
not matter and a paragraph is inserted or deleted by adding or subtracting its vector.  Two
fingerprints are alike by the cosine of their signed lanes, which estimates that of the
paragraph counts.  Only DataFrame functions are used.

The document after another, by descending doc_id, is found from ranges of doc_id: each range
is ordered by itself, and the ends of the ranges (a bounded number) are linked.

Cases: null text counts as empty, with the zero fingerprint; two zero fingerprints have
likeness 1, one alone 0; of rows that repeat a doc_id each is fingerprinted, and the next
document is the one with the next other doc_id (one of its rows if that repeats: the least by a hash
and then by text); a null doc_id counts as the smallest, together with the least number that there
is; a table of one doc_id has itself as the next; very long texts are read whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.base import settle

UNIFORM, SIGNED = 8, 128
RANGES = 256
#: Rows of one doc_id, a null one too, are spread over so many parts by their text.
SALTS = 64
#: Stands for a null doc_id, before all others.
NULL_ID = -(2**63)
#: Paragraphs end at a line break, or after a sentence sign and a blank.
PARAGRAPH = r"\n|(?<=[.!?]) "
#: Longer ones (characters) end after a vowel and a blank, too; texts of fewer characters than SHORT are cut at all blanks.
LONG, INSIDE, SHORT = 300, "(?<=[aeiouy]) ", 400


def paragraphs(text: str | Column) -> Column:
    whole = F.col(text) if isinstance(text, str) else text
    inner = F.flatten(F.transform(F.split(whole, PARAGRAPH), lambda p: F.when(F.length(p) > LONG, F.split(p, INSIDE)).otherwise(F.array(p))))
    return F.filter(F.when(F.length(whole) < SHORT, F.split(whole, "\n| ")).otherwise(inner), lambda p: p != "")


def summed(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wide, signed: the fingerprint of the paragraphs ``p`` of each group; null ones count nothing."""
    some = F.col("p").isNotNull()
    for i in range(UNIFORM // 2):
        hashed = hashed.withColumn(f"u{i}", F.xxhash64(F.lit(f"u{i}"), "p"))
    for i in range(SIGNED // 64):
        hashed = hashed.withColumn(f"s{i}", F.xxhash64(F.lit(f"s{i}"), "p"))
    hashed = hashed.withColumn("one", some.cast("int"))
    wide = [x for i in range(UNIFORM // 2) for x in (F.sum(F.when(some, F.col(f"u{i}").bitwiseAND(2**32 - 1))), F.sum(F.when(some, F.shiftrightunsigned(f"u{i}", 32))))]
    signed = [F.sum(F.when(some, F.shiftrightunsigned(f"s{i}", b).bitwiseAND(1))) for i in range(SIGNED // 64) for b in range(64)]
    total = hashed.groupBy(*keys).agg(F.sum("one").alias("n"), *[c.alias(f"l{i}") for i, c in enumerate(wide + signed)])
    first = [F.pmod(F.coalesce(f"l{i}", F.lit(0)), F.lit(2**32)) for i in range(UNIFORM)]
    # From -2**15 to 2**15 - 1, the residue modulo 2**16 that is nearest to zero.
    rest = [(F.pmod(2 * F.coalesce(f"l{i + UNIFORM}", F.lit(0)) - F.col("n") + 2**15, F.lit(2**16)) - 2**15).cast("short") for i in range(SIGNED)]
    return total.select(*keys, F.array(*first).alias("wide"), F.array(*rest).alias("signed"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the signed lanes of two fingerprints, from 0 to 1."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda total, v: total + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size)))


def as_text(wide: Column, signed: Column) -> Column:
    """Hexadecimal digits of the lanes: eight for each 32-bit word, four for each signed lane."""
    first = F.transform(wide, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0"))
    rest = F.transform(signed, lambda v: F.lpad(F.lower(F.hex(v.cast("int").bitwiseAND(2**16 - 1))), 4, "0"))
    return F.concat(F.array_join(first, ""), F.array_join(rest, ""))


def fingerprint(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, wide, signed: one fingerprint for each key; rows of one key are inserted into one set."""
    return summed(docs.select(key, F.explode_outer(paragraphs(F.coalesce("text", F.lit("")))).alias("p")), [key])


def combined(a: DataFrame, b: DataFrame, key: str = "doc_id", sign: int = 1) -> DataFrame:
    """Fingerprints of the sets with those of b inserted (sign 1) or deleted (-1)."""
    def zipped(x: str, y: str, size: int, low: int, kind: str) -> Column:
        return F.zip_with(x, y, lambda p, q: (F.pmod(p.cast("long") + sign * q.cast("long") - low, F.lit(size)) + low).cast(kind))

    other = b.select(key, F.col("wide").alias("w2"), F.col("signed").alias("s2"))
    return a.join(other, key).select(key, zipped("wide", "w2", 2**32, 0, "long").alias("wide"), zipped("signed", "s2", 2**16, -(2**15), "short").alias("signed"))


def next_ids(ids: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(k, next_k) for each of different k: the next smaller, or for the least the greatest."""
    cuts = ids.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.0005) if ranges > 1 else []
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = ids.withColumn("range", F.size(F.filter(cut, lambda c: c < F.col("k"))))
    inside = ranged.withColumn("before", F.lag("k").over(Window.partitionBy("range").orderBy("k")))
    ends = ranged.groupBy("range").agg(F.min("k").alias("k"), F.max("k").alias("high"))
    # One row for each range, in one task.
    linked = ends.select("k", F.coalesce(F.lag("high").over(Window.orderBy("range")), F.max("high").over(Window.partitionBy())).alias("far"))
    return inside.join(F.broadcast(linked), "k", "left").select("k", F.coalesce("before", "far").alias("next_k"))


def _salted(docs: DataFrame) -> DataFrame:
    """k, salt, text: salts from SALTS on mark a null doc_id."""
    text = F.coalesce("text", F.lit(""))
    salt = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int") + F.when(F.col("doc_id").isNull(), SALTS).otherwise(0)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), salt.alias("salt"), text.alias("text"))


def placed_texts(docs: DataFrame) -> DataFrame:
    """k, salt, text, place, first: one per row, (k, salt, place) unique; a null doc_id has the least k.

    Every use of it asks for the same columns, so that the texts are shuffled once; a limit on
    ``place`` would be applied before the shuffle and make another one of it, so ``first`` is
    told by the row before.
    """
    order = Window.partitionBy("k", "salt").orderBy("text")
    return _salted(docs).withColumns({"place": F.row_number().over(order), "first": F.lag("k").over(order).isNull()})


def asks(docs: DataFrame) -> DataFrame:
    """(k, salt, asker, asker_salt, half): the row that is next to the asker's, and how much of it is asked for."""
    half = F.floor(F.max(F.char_length("text")) / 2).cast("int").alias("half")
    sizes = settle(_salted(docs).groupBy("k", "salt").agg(half))
    heads = settle(sizes.groupBy("k").agg(F.min("salt").alias("salt")))
    after = next_ids(heads.select("k")).join(heads.select(F.col("k").alias("next_k"), F.col("salt").alias("next_salt")), "next_k")
    return settle(sizes.join(after, "k").select(F.col("next_k").alias("k"), F.col("next_salt").alias("salt"), F.col("k").alias("asker"), F.col("salt").alias("asker_salt"), "half"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    of the next document.  Only heads of texts and lanes travel to the document before.
    """
    placed, asked = placed_texts(docs), asks(docs)
    first = placed.where("first")
    heads = first.join(asked, ["k", "salt"]).select(F.col("asker").alias("k"), F.col("asker_salt").alias("salt"), F.expr("substring(text, 1, half)").alias("head"))
    whole = first.select("k", "salt", F.explode_outer(paragraphs("text")).alias("p"))
    lanes = summed(whole, ["k", "salt"]).join(asked, ["k", "salt"]).select(F.col("asker").alias("k"), F.col("asker_salt").alias("salt"), F.col("signed").alias("next_signed"))
    texts = placed.join(heads, ["k", "salt"]).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.expr("concat(substring(text, 1, int(n_chars) - half), substring(head, 1, half))")
    both = F.concat(F.transform(paragraphs("text"), lambda p: F.struct(F.lit(0).alias("kind"), p.alias("p"))), F.transform(paragraphs("edited"), lambda p: F.struct(F.lit(1).alias("kind"), p.alias("p"))))
    keys = ["k", "salt", "place", "n_chars", "edited_sha256"]
    cut = texts.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.explode_outer(both).alias("one")).select(*keys, F.coalesce("one.kind", F.lit(0)).alias("kind"), "one.p")
    sums = summed(cut, [*keys, "kind"])
    none = F.array_repeat(F.lit(0).cast("long"), UNIFORM), F.array_repeat(F.lit(0).cast("short"), SIGNED)
    pick = lambda c, kind, empty: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), empty)
    own = sums.groupBy(*keys).agg(*[pick(c, i, e).alias(f"{c}{i}") for c, e in zip(("wide", "signed"), none, strict=True) for i in (0, 1)])
    return own.join(lanes, ["k", "salt"]).select(
        F.when(F.col("salt") < SALTS, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("wide0"), F.col("signed0")).alias("fingerprint"),
        as_text(F.col("wide1"), F.col("signed1")).alias("edited_fingerprint"),
        likeness(F.col("signed0"), F.col("signed1")).alias("near_edited"),
        likeness(F.col("signed0"), F.col("next_signed")).alias("near_next"),
    )
