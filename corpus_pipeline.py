"""A corpus from raw documents: quality, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of ``documents``.  ``run`` writes each stage's result to the shared checkpoint folder and reads
it again for the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm import jaccard, packing, quality, substring, toxicity
from meterflow.llm.base import prepare, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail and go; rows that repeat a doc_id or have none are judged each on its own;
    an empty table stays empty; all columns are kept as they are.
    """
    return quality.judge(docs, carry=True).where("kept").select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold.

    Labels of documents that an earlier stage rejected teach nothing; null and empty texts are scored
    like others; equal texts stay or go together, whatever their ids; an empty table stays empty; all
    columns are kept as they are.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return model.score(whole, "row").where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of each group of near copies: that of the smallest doc_id.

    Of equal rows one stays; texts without words are groups of their own and stay; a group of null ids
    keeps one of them; an empty table stays empty; all columns are kept as they are.
    """
    return jaccard.firsts(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; n_chars follows the text.

    Null texts become empty; a null doc_id is neither earlier nor later than others; rows of one
    doc_id are not earlier than each other; documents left without words stay, empty; an empty table stays
    empty; other columns are kept as they are.
    """
    cut = substring.dedup_substrings(docs)
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"row.{c}") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece.

    Null and empty texts are one piece, the closing token; every row is packed, whatever its id; an
    empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_copies), ("substring dedup", repeated_passages), ("best-fit packing", packed)]

#: SQL has no gradient-boosted trees and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
