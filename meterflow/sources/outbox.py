"""An outbox: a table to which each key is delivered once, whoever delivers and however often.

path/data/<delivery> holds the rows of one delivery, path/manifest/<number> is one line (JSON) for each
committed one: its folder, and the range of its first key, so that a delivery only reads folders that
may hold its keys.  Only what the manifest names is part of the table.  A delivery writes its folder,
then renames its line into place under the next number; if another one has taken that number, it reads what
was added and tries again.  So a delivery that ends half way leaves nothing that is read, and a
repeated one finds its keys there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outbox:
    """Rows by key; of rows of one key in a delivery the one of the greatest ``order`` goes out."""

    path: str
    keys: tuple[str, ...] = ("round_id", "agent_id")
    order: str = "seq"

    def _fs(self, spark: SparkSession):  # noqa: ANN202
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def entries(self, spark: SparkSession) -> list[dict]:
        """The committed deliveries, by number."""
        fs, path = self._fs(spark)
        folder = path(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())
        if not names:
            return []
        lines = spark.read.text([f"{self.path}/manifest/{n}" for n in names]).collect()  # one line a delivery
        return sorted((json.loads(r.value) for r in lines), key=lambda e: e["number"])

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """All delivered rows; a schema is needed while there are none."""
        folders = [e["folder"] for e in self.entries(spark)]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.parquet(*folders)

    def deliver(self, batch: DataFrame) -> None:
        """Adds the rows whose keys are not there yet; rows without a key are never delivered."""
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in self.keys]
        newest = batch.dropna(subset=list(self.keys)).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("row")).select(*self.keys, "row.*")
        seen: set[str] = set()
        while True:
            known = self.entries(spark)
            fresh = [e for e in known if e["folder"] not in seen]
            seen |= {e["folder"] for e in fresh}
            bounds = newest.agg(F.min(self.keys[0]).cast("string").alias("low"), F.max(self.keys[0]).cast("string").alias("high"), F.min(self.keys[0]).alias("a"), F.max(self.keys[0]).alias("b")).first()
            if bounds["a"] is None:
                return
            kind = type(bounds["a"])
            near = [e["folder"] for e in fresh if kind(e["low"]) <= bounds["b"] and kind(e["high"]) >= bounds["a"]]
            if near:
                newest = newest.join(spark.read.parquet(*near).select(*self.keys), list(self.keys), "left_anti")
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            newest.write.parquet(folder)
            made = spark.read.schema(newest.schema).parquet(folder)
            if made.isEmpty():
                return
            if self._commit(spark, known[-1]["number"] + 1 if known else 0, folder, bounds["low"], bounds["high"]):
                return
            newest = made  # another delivery took the number: what it added is looked at, too

    def _commit(self, spark: SparkSession, number: int, folder: str, low: str, high: str) -> bool:
        """Puts the line into place, unless there is one of that number."""
        fs, path = self._fs(spark)
        fs.mkdirs(path(f"{self.path}/manifest"))
        own, final = path(f"{self.path}/manifest/_{uuid.uuid4().hex}"), path(f"{self.path}/manifest/{number:012d}")
        out = fs.create(own)
        out.write(bytearray(json.dumps({"number": number, "folder": folder, "low": low, "high": high}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(own, final):
            fs.delete(own, False)
            return False
        return True
