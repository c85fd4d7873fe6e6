"""What the operators of this subpackage share: settings, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows of one Arrow batch; texts are long, so few.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and a checkpoint folder: the cluster's, or else (with a local master only) our own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Computes a frame once and keeps it as a compressed table in the shared checkpoint folder."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key of more than one of so many rows, and of more than SMALL rows, is hot; so there are at most HOT hot keys.
HOT, SMALL = 1000, 2000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """left joined to right, which has each key once and in ``count`` how many rows of left have it.

    Hot keys, at most ``HOT`` rows of right, are broadcast, so that rows of one key need not meet in one
    task.  Both sides are read more than once: they should be settled.  ``total`` may give a bound on
    the rows of left that is known already, if there are hot keys.
    """
    if total is None:
        total, most = right.agg(F.sum(count), F.max(count)).first()
        if not is_hot(most or 0, total or 0):
            return left.join(right.drop(count), keys)
    limit = F.lit(max(total / HOT, SMALL))
    hot, rest = right.where(F.col(count) > limit).drop(count), right.where(F.col(count) <= limit).drop(count)
    seldom = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return left.join(F.broadcast(hot), keys).unionByName(seldom)


def is_hot(count: int, total: int) -> bool:
    return count > max(total / HOT, SMALL)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and other named columns only, so that extra columns never clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def text_hash(column: str = "text") -> F.Column:
    """31 bits of a text's hash, to tell rows apart that repeat a doc_id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(column), F.lit(""))), 33)


def fields(df: DataFrame, names: list[str], more: str) -> StructType:
    """The schema of the named columns, followed by new ones given as DDL."""
    new = df.sparkSession.createDataFrame([], more).schema
    return StructType([StructField(n, df.schema[n].dataType) for n in names] + list(new))


#: What a Python worker keeps from task to task, by name and key; of one name at a time, so that what
#: the stages of a pipeline keep does not add up.
_KEPT: dict[tuple[str, object], object] = {}


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker that tasks use one after the other."""
    if any(n != name for n, _ in _KEPT):
        _KEPT.clear()
    if (name, key) not in _KEPT:
        _KEPT[name, key] = make()
    return _KEPT[name, key]


def hand_back() -> None:
    """Gives the memory that a task has freed back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def without_gc(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, without garbage rounds: lists of many short strings, without cycles, are traversed again and again.

    What it has freed goes back to the system when it ends.
    """

    def quiet(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(them)
        finally:
            gc.enable()
            hand_back()

    return quiet


def per_batch(df: DataFrame, schema: str | StructType, work: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow with columns as lists in and out; work gets one batch, of bounded rows."""
    prepare(df.sparkSession)
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out_schema)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            if batch.num_rows:
                out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(without_gc(run), out_schema)


def plain(data: bytes) -> str:
    """The text of a packed one."""
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns, and ``packed``: the text (null: empty) compressed, for texts that are shuffled."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return {k: rows[k] for k in keep} | {"packed": [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in rows["text"]]}

    return per_batch(df.select(*keep, "text"), fields(df, list(keep), "packed binary"), work)
