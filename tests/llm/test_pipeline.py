"""The stages over the given table, and over small tables with nulls, repeats, clashing columns and nothing at all."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
        assert docs.count() <= before
        assert docs.select("doc_id").distinct().count() == docs.count()
        before = docs.count()
    assert before > 50
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


@pytest.fixture(scope="module")
def prose(spark):
    """Texts of the given table that are kept by all rules, longest first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.toxicity_filter(spark, corpus_pipeline.quality_rules(spark, docs, SF), SF)
    return [r.text for r in good.where("lang = 'en' and char_length(text) between 400 and 3000").orderBy("doc_id").limit(12).collect()]


def odd_rows(prose):
    """Rows with repeated and null ids, equal rows, null and empty texts."""
    a, b, c, d, *_ = prose
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (None, d), (7, None), (7, ""), (8, "x"), (9, "*** " * 300)]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def table(spark, docs, rows):
    """The given documents, for the statistics, and the odd rows."""
    return docs.where("doc_id >= 0").withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(spark.createDataFrame(rows, COLUMNS))


def odd(df):
    return Counter((r.doc_id, r.text) for r in df.where("doc_id is null or doc_id < 100000").collect())


def test_filters_keep_rows_as_they_are(spark, prose):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = odd_rows(prose)
    a, b, c, d, *_ = prose
    want = Counter({(1, a): 2, (1, b): 1, (None, c): 2, (None, d): 1})
    extra = table(spark, docs, rows).selectExpr("*", "1 as row", "2 as kept", "3 as score", "4 as held_out")
    kept = corpus_pipeline.quality_rules(spark, extra, SF)
    assert kept.columns == extra.columns and odd(kept) == want
    mild = corpus_pipeline.toxicity_filter(spark, kept, SF)
    assert mild.columns == extra.columns and odd(mild) == want


def test_near_copies_keep_one_row_of_a_group(spark, prose):
    docs = spark.createDataFrame(odd_rows(prose), COLUMNS).selectExpr("*", "1 as node", "2 as h", "3 as id0")
    left = corpus_pipeline.near_copies(spark, docs, SF)
    a, b, c, d, *_ = prose
    assert left.columns == docs.columns
    assert odd(left) == Counter({(1, a): 1, (1, b): 1, (None, c): 1, (None, d): 1, (7, None): 1, (7, ""): 1, (8, "x"): 1, (9, "*** " * 300): 1})
    again = corpus_pipeline.near_copies(spark, left, SF)
    assert odd(again) == odd(left)


def test_repeated_passages_leave_the_rest(spark, prose):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(70))
    rows = [(3, passage, "en", "s", 1), (5, f"before {passage} after", "en", "s", 1), (5, f"before {passage} after", "en", "s", 1), (None, passage, None, None, None), (6, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as row", "2 as spans", "3 as kept")
    cut = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert cut.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.n_chars) for r in cut.collect())
    assert got == Counter({(3, passage, len(passage)): 1, (5, "before after", 12): 2, (None, passage, len(passage)): 1, (6, "", 0): 1})


def test_packing_places_every_row(spark, prose):
    docs = spark.createDataFrame(odd_rows(prose), COLUMNS).selectExpr("*", "1 as piece", "2 as length", "3 as salt")
    out = corpus_pipeline.packed(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, *_ in odd_rows(prose))
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.packed(spark, docs, SF).count() == 0
