"""Streams of readings, uploads and rounds; each has a batch twin that gives the same rows.

State is keyed by household, agent or district and bounded: a few numbers, a fixed number of
readings, what waits for the watermark, or the uploads of one open round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from meterflow.operators.control import shed_plan
from meterflow.operators.memory import significant_episode
from meterflow.operators.prepare import HOUSEHOLD, WEATHER
from meterflow.plans.federated import RoundConfig, district_deltas
from meterflow.sources.outbox import Outbox
from meterflow.streaming.ordered import TOGETHER, Capacity, Drift, Patterns, Recent, complete, in_order


def stream_meter(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Readings from Parquet files as they arrive; ``ts`` becomes a timestamp, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_resample(df: DataFrame, lateness: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Sums per household and slot, each given out once the watermark has passed it."""
    w = df.withWatermark("ts", lateness).groupBy(HOUSEHOLD, F.window("ts", width).alias("w")).agg(F.sum("kwh").alias("kwh"))
    return w.select(HOUSEHOLD, F.col("w.start").alias("ts"), "kwh")


def late_policy(df: DataFrame, lateness: str, path: str, checkpoint: str) -> StreamingQuery:
    """Splits a stream by its own watermark: rows in time go to path/fine, late ones to path/late.

    A row is late if its ts is not after the watermark: the greatest ts of all earlier batches less the
    lateness.  Each batch keeps the greatest ts so far in path/marks, under its number, so that a replayed
    batch is split as before and writes over its own folders.  A row without ts is late.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = spark.read.parquet(f"{path}/marks/batch={number - 1}").first()["top"] if number else None
        late = F.col("ts").isNull() if top is None else F.col("ts").isNull() | (F.col("ts") <= F.lit(top) - F.expr(f"interval {lateness}"))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/fine/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        most = batch.agg(F.greatest(F.max("ts"), F.lit(top).cast(dict(batch.dtypes)["ts"])).alias("top"))
        most.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return df.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _State(StatefulProcessor):
    """One JSON text per key, restored with the checkpoint."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("cell", "value string")

    def load(self, default: Any) -> Any:
        return json.loads(self.cell.get()[0]) if self.cell.exists() else default

    def save(self, value: Any) -> None:
        self.cell.update((json.dumps(value),))

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by))


class _Cohort(StatefulProcessor):
    """The open round of a district: its number, its deadline, and the newest upload of each agent."""

    def __init__(self, deadline: int, first: int) -> None:
        self.deadline, self.first = deadline, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "round_id long, until long, expected array<long>")
        self.uploads = handle.getMapState("uploads", "agent_id long", "n_samples long, vector array<double>, mask array<boolean>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, until, _ = self.open.get() if self.open.exists() else (self.first, 0, None)
        before, expected, got = until, [], self._sent()
        out: list[tuple] = []
        for r in _in_order(rows, "ts", "seq").itertuples():
            expected, at = [] if r.expected is None else r.expected.tolist(), int(r.ts.value // 1_000_000)
            if until and at > until:  # the watermark will pass the deadline, too
                out += _closed(key[0], now, "deadline", got, expected)
                now, until, got = now + 1, 0, {}
            status = "stale" if r.round_id < now else "future" if r.round_id > now else "unknown" if r.agent_id not in expected else "invalid" if r.vector is None or not len(r.vector) else None
            if status:
                out.append((key[0], r.round_id, status, r.agent_id, None, None, None, None, None))
                continue
            mask = [True] * len(r.vector) if r.mask is None else r.mask.tolist()
            # A repeated upload replaces the former one.
            got[int(r.agent_id)] = (int(r.n_samples) if r.n_samples > 0 else 1, r.vector.tolist(), mask)
            until = until or at + self.deadline
            if len(got) == len(expected):
                out += _closed(key[0], now, "complete", got, expected)
                now, until, got = now + 1, 0, {}
        # State is written once: only the round that is open now needs a timer; that of a closed one finds another time.
        self.uploads.clear()
        for agent, sent in got.items():
            self.uploads.updateValue((agent,), sent)
        if until and until != before:
            self.handle.registerTimer(until)
        self.open.update((now, until, expected))
        yield _rounds(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, until, expected = self.open.get()
        if until and until == expiredTimerInfo.getExpiryTimeInMs():
            out = _closed(key[0], now, "deadline", self._sent(), expected)
            self.uploads.clear()
            self.open.update((now + 1, 0, expected))
            yield _rounds(out)

    def _sent(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.uploads.iterator()}

    def close(self) -> None:
        pass


def _closed(district: int, now: int, status: str, got: dict[int, tuple], expected: list[int]) -> list[tuple]:
    """A row for each upload of the round, then one for the round, with the agents that are missing."""
    return [(district, now, "upload", agent, n, list(vector), list(mask), None, None) for agent, (n, vector, mask) in sorted(got.items())] + [(district, now, status, None, None, None, None, len(got), sorted(set(expected) - set(got)))]


_ROUNDS = "district_id long, round_id long, status string, agent_id long, n_samples long, vector array<double>, mask array<boolean>, n long, missing array<long>"


def _rounds(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in _ROUNDS.split(", ")])
    return df.astype({c: "Int64" for c in ("agent_id", "n_samples", "n")})


class _Converge(_State):
    def __init__(self, eps: float, patience: int) -> None:
        self.eps, self.patience = eps, patience

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stable, out = self.load(0), []
        for r in _in_order(rows, "round_id").itertuples():
            stable = stable + 1 if r.drift < self.eps else 0
            out.append((key[0], r.round_id, r.drift, stable, stable >= self.patience))
        self.save(stable)
        yield pd.DataFrame(out, columns=["district_id", "round_id", "drift", "stable_rounds", "converged"])


def _stateful(df: DataFrame, key: str, job: StatefulProcessor, schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=job, outputStructType=schema, outputMode="Append", timeMode="None")


def stream_drift(df: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Readings with their drift flag, in order of time; the running mean and variance are the state."""
    return in_order(df, HOUSEHOLD, Drift(), lateness, f"{HOUSEHOLD} long, ts timestamp, event_id long, kwh double, drift boolean", TOGETHER)


def stream_recent(df: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Per household and release the newest readings, and whether there are enough."""
    return in_order(df, HOUSEHOLD, Recent(), lateness, f"{HOUSEHOLD} long, ts timestamp, recent array<double>, warm boolean", TOGETHER)


def stream_patterns(df: DataFrame, block: int = 32, capacity: int = 4096, lateness: str = "1 hour") -> DataFrame:
    """The mean vector of each full block of an agent, and the block whose place it takes in a pool of so many."""
    return in_order(df, "agent_id", Patterns(block, capacity), lateness, "agent_id long, block long, vector array<double>, replaces long")


def newest_patterns(rows: DataFrame) -> DataFrame:
    """The pool: blocks whose place no later one has taken."""
    gone = rows.where("replaces is not null").select("agent_id", F.col("replaces").alias("block"))
    return rows.drop("replaces").join(gone, ["agent_id", "block"], "left_anti")


def stream_actions(df: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Capacity and shed plan of each reading; one without a forecast is only monitored and does not count in the capacity."""
    limits = in_order(df, HOUSEHOLD, Capacity(), lateness, f"{HOUSEHOLD} long, ts timestamp, event_id long, predicted double, capacity double", TOGETHER)
    return shed_plan(limits)


def stream_cohort(uploads: DataFrame, expected: DataFrame, deadline: str = "1 hour", lateness: str = "1 hour", first_round: int = 0) -> DataFrame:
    """The rounds of districts as uploads (district_id, seq, ts, agent_id, round_id, n_samples, vector, mask) arrive.

    ``expected`` (district_id, agent_id) is a table of those who take part.  A round closes when all of
    them have sent (``complete``), or once the watermark has passed ``deadline`` after its first upload
    (``deadline``, with the agents that are ``missing``); then the next one opens.  Rows: an ``upload`` for each
    of a closed round, the round itself, and a ``stale``, ``future``, ``unknown`` or ``invalid`` one for each
    upload that is turned away.  State is the open round.
    """
    # A left join: an inner one would have rows without a district, which move the watermark, dropped below it.
    uploads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cohort = expected.groupBy("district_id").agg(F.array_sort(F.collect_set(F.col("agent_id").cast("long"))).alias("expected"))
    rows = complete(uploads.select("district_id", "seq", "ts", "agent_id", "round_id", "n_samples", "vector", "mask"), lateness, "district_id", "agent_id", "round_id").join(cohort, "district_id", "left")
    wait = int(pd.Timedelta(deadline).total_seconds() * 1000)
    return rows.groupBy("district_id").transformWithStateInPandas(statefulProcessor=_Cohort(wait, first_round), outputStructType=_ROUNDS, outputMode="Append", timeMode="EventTime")


def stream_rounds(cohorts: DataFrame, path: str, checkpoint: str, config: RoundConfig | None = None) -> StreamingQuery:
    """Aggregates the rounds that ``stream_cohort`` closes: clipped, chosen by Krum, trimmed means.

    path/rounds has all rows of the cohorts, path/deltas the means (district_id, round_id, pos, value,
    contributed), path/audit the agents.  A round of fewer than 2 f + 3 uploads gives no delta.  A replayed
    batch writes over its own folders.
    """
    config = config or RoundConfig()
    keys = ("district_id", "round_id")

    def aggregate(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/rounds/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{path}/rounds/batch={number}")
        enough = rows.where(F.col("status").isin("complete", "deadline") & (F.col("n") >= 2 * config.f + 3)).select(*keys)
        sent = rows.where("status = 'upload'").join(enough, list(keys), "left_semi")
        if sent.isEmpty():
            return
        values = sent.select(*keys, "agent_id", F.posexplode(F.arrays_zip("vector", "mask")).alias("pos", "one"))
        places = values.select(*keys, "pos").distinct()
        present = values.where("one.mask").select(*keys, "agent_id", "pos", F.col("one.vector").alias("value"))
        means, audit = district_deltas(present, sent.select(*keys, "agent_id", "n_samples"), config, keys, places)
        means.write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")
        audit.write.mode("overwrite").parquet(f"{path}/audit/batch={number}")

    return cohorts.writeStream.foreachBatch(aggregate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_convergence(drift: DataFrame, eps: float, patience: int) -> DataFrame:
    """Rounds with the count of stable ones, kept over restarts."""
    return _stateful(drift.select("district_id", "round_id", "drift"), "district_id", _Converge(eps, patience), "district_id long, round_id long, drift double, stable_rounds long, converged boolean")


def stream_outbox(df: DataFrame, outbox: Outbox, checkpoint: str) -> StreamingQuery:
    """Delivers each key once, over replays, lost checkpoints and other cuts of the stream into batches."""
    return df.writeStream.foreachBatch(lambda batch, number: outbox.deliver(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_weather_join(df: DataFrame, weather: DataFrame, lateness: str = "1 hour", weather_lateness: str = "1 hour") -> DataFrame:
    """Readings with the weather of their hour, null where there is none.

    Weather may be a table or a stream.  As a stream it may arrive before or after the readings: both sides
    are kept until the watermarks (the lower of the two) have passed the hour, and a reading whose weather
    has not come by then goes out without it.
    """
    hourly = weather.select(F.col("weather_id").alias("w_id"), F.col("ts").cast("timestamp").alias("hour_ts"), *WEATHER)
    if not weather.isStreaming:
        placed = df.withColumn("hour", F.date_trunc("hour", "ts"))
        return placed.join(hourly, (F.col("weather_id") == F.col("w_id")) & (F.col("hour") == F.col("hour_ts")), "left").drop("hour", "hour_ts", "w_id")
    left = complete(df, lateness, HOUSEHOLD).withColumn("hour", F.date_trunc("hour", "ts"))
    # Never null, so that the join does not have rows without a station, which move the watermark, dropped below it.
    right = hourly.withWatermark("hour_ts", weather_lateness).withColumn("w_id", F.coalesce("w_id", F.lit("")))
    same = (F.col("weather_id") == F.col("w_id")) & (F.col("hour") == F.col("hour_ts"))
    near = (F.col("hour_ts") <= F.col("ts")) & (F.col("ts") < F.col("hour_ts") + F.expr("interval 1 hour"))
    return left.join(right, same & near, "left").drop("hour", "hour_ts", "w_id")


def stream_episodes(df: DataFrame) -> DataFrame:
    """Significant episodes, to be appended to a journal."""
    return significant_episode(df)
