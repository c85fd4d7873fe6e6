"""Results that are computed once and used again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset and Spark is local (in tests) one of our own."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir")
    if not known and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return known or tempfile.mkdtemp(prefix="checkpoint-")


def settle(df: DataFrame) -> DataFrame:
    """Computes a frame and keeps it as a compressed table in the shared folder, so that later plans start from it and read only what they need."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
