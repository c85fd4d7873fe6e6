"""Feature stores with published versions, audits, manifests, round checkpoints."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets of a feature store, and rows of a file at which a range is cut.
BUCKETS = 64
#: Where a store keeps its zone map; a name that readers of the store pass over.
ZONES = "_zones"


def household_bucket(buckets: int) -> Column:
    """The bucket of a household, by a hash of its id as text."""
    return F.pmod(F.xxhash64(F.col("household_id").cast("string")), F.lit(buckets)).cast("int")


def write_features(df: DataFrame, path: str, buckets: int = BUCKETS, files: int | None = None) -> None:
    """A store in hash buckets, sorted by household and time, with a zone map; an error if it exists.

    Rows are dealt to ``files`` ranges of (bucket, household, ts), as many as buckets unless given: their number
    does not hang on that of the households, and one that has very many rows is cut by time.  The zone map
    has the bucket and the least and greatest household of each file, so that a reader opens only the files
    that may hold its households.
    """
    spark = df.sparkSession
    name = F.col("household_id").cast("string")
    placed = df.withColumn("bucket", household_bucket(buckets))
    dealt = placed.repartitionByRange(files or buckets, "bucket", name, "ts").sortWithinPartitions("bucket", name, "ts")
    dealt.write.partitionBy("bucket").mode("errorifexists").parquet(path)
    made = spark.read.schema(placed.schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), "bucket", "household_id", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.lit(1).alias("n"))
    write_zones(made, path, buckets)


def write_ordered(df: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of such a store, of a frame that lies in ranges of (bucket, household) and in that order already; what was written.

    Nothing is shuffled or sorted; the bucket is a column of the files, in place of a folder of its own.  The zone
    map is left to ``write_zones``.
    """
    placed = df.withColumn("bucket", household_bucket(buckets))
    placed.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def write_zones(parts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The zone map of a store, from (file, bucket, household_id, first_ts, last_ts, n) of its rows or households."""
    name = F.col("household_id").cast("string")
    zones = parts.groupBy("file", "bucket").agg(F.min(name).alias("low"), F.max(name).alias("high"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"))
    zones.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/{ZONES}")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this program has written and not published."""
    fs, made = _files(spark, path)
    fs.delete(made(path), True)


def write_partitioned(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """A store with a directory for each value of few columns; an error if it exists."""
    df.repartition(*partition_by).sortWithinPartitions(*partition_by).write.partitionBy(*partition_by).mode("errorifexists").parquet(path)


def _files(spark: SparkSession, root: str) -> tuple[Any, Any]:
    hadoop = spark._jvm.org.apache.hadoop
    path = hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.fs.Path


def checked(run_id: str) -> str:
    if not run_id or run_id in (".", "..") or "/" in run_id or "\\" in run_id:
        raise ValueError(f"not a run id: {run_id!r}")
    return run_id


def publish_version(df: DataFrame, root: str, run_id: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes runs/<id>, in buckets or by the named columns, and then points CURRENT at it."""
    target = f"{root}/runs/{checked(run_id)}"
    if partition_by:
        write_partitioned(df, target, partition_by)
    else:
        write_features(df, target)
    point(df.sparkSession, root, run_id)
    return target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    fs, made = _files(spark, path)
    out = fs.create(made(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def point(spark: SparkSession, root: str, run_id: str) -> None:
    """Points CURRENT at a run by one rename over the old pointer.

    Readers meet the old run or the new one: at no time is there no pointer, where the file system renames
    atomically (HDFS does).
    """
    fs, path = _files(spark, root)
    fresh = f"{root}/.CURRENT-{checked(run_id)}"
    write_text(spark, fresh, run_id)
    _replace(spark, fs, path(fresh), path(f"{root}/CURRENT"))


def _replace(spark: SparkSession, fs: Any, fresh: Any, current: Any) -> None:
    """Renames a file over another one."""
    context = spark.sparkContext
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = context._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(fresh), fs.makeQualified(current), how)


def current_run(spark: SparkSession, root: str) -> str | None:
    """The published run's id, or None where nothing was published."""
    fs, path = _files(spark, root)
    if not fs.exists(path(f"{root}/CURRENT")):
        return None
    run_id = checked(spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0].strip())
    if not fs.exists(path(f"{root}/runs/{run_id}")):
        raise FileNotFoundError(f"run {run_id} is published but absent in {root}")
    return run_id


def resolve_current(spark: SparkSession, root: str) -> str:
    """The published run's folder, or the root itself where nothing was published."""
    run_id = current_run(spark, root)
    return f"{root}/runs/{run_id}" if run_id else root


def append_audit(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("district_id", "round_id")) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_rows(spark: SparkSession, rows: list[dict], path: str, schema: str, partition_by: tuple[str, ...] = ()) -> None:
    """Rows of a program's own (few); nested values as JSON text, a null partition as ``null``."""
    df = spark.createDataFrame(rows, schema)
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df = df.withColumns({c: F.to_json(c) for c in nested} | {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in partition_by})
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_manifest(selected: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """A cohort (a bounded selection) as one JSON document, with the given facts about it."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("household_id").cast("string").alias("household_id"), F.col("cluster").cast("int").alias("cluster"), F.col("rank_in_cluster").cast("int").alias("rank_in_cluster"))))
    selected.agg(rows.alias("selected"), *[F.lit(v).alias(k) for k, v in (meta or {}).items()]).coalesce(1).write.mode("overwrite").json(path)


def checkpoint_round(w: DataFrame, path: str, round_id: int) -> None:
    """The global vector of a round; a repeated round replaces its own."""
    w.write.mode("overwrite").parquet(f"{path}/round={round_id}")


def resume_round(spark: SparkSession, path: str, round_id: int) -> DataFrame:
    """The vector that a round starts from: the one of the round before."""
    return spark.read.parquet(f"{path}/round={round_id - 1}")
