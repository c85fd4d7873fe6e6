"""Streaming jobs as registered queries: a table's files are drained as a stream into a sink."""

from __future__ import annotations

import time
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.plans import file_queries  # noqa: F401  (registers its queries)
from meterflow.plans import views as v
from meterflow.plans.federated import RoundConfig
from meterflow.plans.lineage import shared_folder
from meterflow.plans.queries import _BLOCKS, _SQL, _long_pos, _r, oracle_sql, queries, query
from meterflow.sources.outbox import Outbox
from meterflow.streaming import jobs

#: The batch queries and the ones below.
__all__ = ["oracle_sql", "queries"]

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def drain(df: DataFrame) -> DataFrame:
    """Runs a stream over what there is and returns the rows that its sink holds.

    Sink and state lie in the shared checkpoint folder, or in one of our own in tests.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


#: Files of a stream that comes in piece by piece, and how late its rows are at most.
FILES, DELAY = 5, 6 * 3600


def arrivals(df: DataFrame, seq: str = "event_id", ends: bool = True) -> DataFrame:
    """The rows (with ``ts``) as a stream of files, in the order in which they come in: up to DELAY seconds late.

    How late a row is hangs on its ``seq``.  The last file ends the feed with a row that has only a time, so that
    the watermark passes all others.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    come = F.unix_micros("ts") + F.expr(f"(({seq} * 7919) % 1000) * {DELAY * 1000}")
    placed = df.withColumn("come", come)
    low, high, last = placed.agg(F.min("come"), F.max("come"), F.max("ts")).first()
    part = F.expr(f"({FILES} * (come - {low})) div {high - low + 1}")
    pieces = [placed.where(part == i).drop("come") for i in range(FILES)]
    if ends:
        pieces.append(spark.createDataFrame([(last + timedelta(days=9),)], "ts timestamp").select(*[F.col(c) if c == "ts" else F.lit(None).cast(k).alias(c) for c, k in df.dtypes]))
    began = int(time.time() * 1000) - 100_000
    for i, piece in enumerate(pieces):
        piece.coalesce(1).write.parquet(f"{folder}/{i}")
        # The source takes the oldest file first; files may be written faster than a file system's clock ticks.
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            fs.setTimes(status.getPath(), began + 5000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


_COME = f"select *, {FILES} * (come - min(come) over ()) // (max(come) over () - min(come) over () + 1) as part from (select *, epoch_us(ts) + ((event_id * 7919) % 1000) * {DELAY * 1000} as come from readings)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    # A pattern, as a stream takes a plain path for a folder, and the table may be one file.
    return jobs.stream_meter(spark, f"{d}/events[.]parquet", EVENTS)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("user_id").alias("household_id"), "ts", "event_id", F.col("value").alias("kwh"))


def _arriving(spark: SparkSession, d: str, ends: bool = True, **more: Column) -> DataFrame:
    return arrivals(v.readings(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumns(more), ends=ends)


@query(f"select event_id, household_id, {_r('kwh', 'kwh')} from readings")
def stream_meter(spark: SparkSession, d: str) -> DataFrame:
    return drain(_readings(spark, d).select("event_id", "household_id", "kwh"))


@query(f"select household_id, time_bucket(interval 15 minutes, ts) as ts, {_r('sum(kwh)', 'kwh')} from meter group by 1, 2 having time_bucket(interval 15 minutes, ts) + interval 15 minutes <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from meter)")
def stream_resample(spark: SparkSession, d: str) -> DataFrame:
    return drain(jobs.stream_resample(_readings(spark, d)))


LATENESS = f"{DELAY} seconds"


@query()
def stream_drift(spark: SparkSession, d: str) -> DataFrame:
    return drain(jobs.stream_drift(_arriving(spark, d), LATENESS)).select("household_id", "event_id", "drift")


_SQL["stream_drift"] = _SQL["drift_flags"]


@query(f"select household_id, max(ts) as ts, least(96, count(*))::int as n, count(*) >= 96 as warm, {_r('sum(kwh) filter (i <= 96)', 'total')} from (select *, row_number() over (partition by household_id order by ts desc, event_id desc) as i from readings) group by 1")
def stream_recent(spark: SparkSession, d: str) -> DataFrame:
    rows = drain(jobs.stream_recent(_arriving(spark, d), LATENESS))
    last = rows.groupBy("household_id").agg(F.max(F.struct("ts", "recent", "warm")).alias("last")).select("household_id", "last.*")
    return last.select("household_id", "ts", F.size("recent").alias("n"), "warm", F.aggregate("recent", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(f"select label::bigint as agent_id, block, pos, {_r('avg(value)', 'value')} from (select label, block, unnest(range(0, 64)) as pos, unnest(embedding)::double as value from blocks where block < full_blocks) group by 1, 2, 3", more={"blocks": _BLOCKS})
def stream_patterns(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    vectors = e.select(F.col("label").cast("long").alias("agent_id"), F.timestamp_seconds(F.col("vec_id") + 86400).alias("ts"), F.col("vec_id").alias("event_id"), F.col("embedding").cast("array<double>").alias("vector"))
    pool = jobs.newest_patterns(drain(jobs.stream_patterns(arrivals(vectors), 32, lateness=LATENESS)))
    return _long_pos(pool.select("agent_id", "block", F.posexplode("vector").alias("pos", "value")))


@query("select event_id, household_id, round(case when i < 96 then 1.2 else greatest(0.5, q) end, 6) as capacity from (select r.event_id, r.household_id, i, q from readings r left join (select *, row_number() over (partition by household_id order by ts, event_id) as i, quantile_cont(kwh, 0.95) over (partition by household_id order by ts, event_id rows between 671 preceding and current row) as q from readings where event_id % 5 <> 0) f using (event_id) where i is not null) union all select event_id, household_id, null from readings where event_id % 5 = 0")
def stream_actions(spark: SparkSession, d: str) -> DataFrame:
    predicted = F.when(F.col("event_id") % 5 != 0, F.col("kwh"))
    return drain(jobs.stream_actions(_arriving(spark, d, predicted=predicted), LATENESS)).select("event_id", "household_id", "capacity")


COHORT = 12


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of each label in turns of COHORT agents, some coordinates masked."""
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = v.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("district_id"), F.col("vec_id").alias("seq"), F.timestamp_seconds(F.col("vec_id") + 86400).alias("ts"), i.alias("i"), (1 + F.col("vec_id") % 7).alias("n_samples"), F.col("embedding").cast("array<double>").alias("vector"))
    mask = F.transform("vector", lambda x, pos: (F.col("seq") + pos) % 11 != 0)
    return rows.select("district_id", "seq", "ts", (F.col("i") % COHORT).cast("long").alias("agent_id"), F.floor(F.col("i") / COHORT).cast("long").alias("round_id"), "n_samples", "vector", mask.alias("mask"))


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Rounds as their uploads come in, in order; the last one of a district is closed by its deadline."""
    rows = _uploads(spark, d)
    expected = rows.select("district_id", F.explode(F.sequence(F.lit(0), F.lit(COHORT - 1))).alias("agent_id")).distinct()
    return jobs.stream_cohort(arrivals(rows, "0"), expected, "1 day", LATENESS)


_UPLOADS = f"select label::bigint as district_id, vec_id, i % {COHORT} as agent_id, i // {COHORT} as round_id, embedding from (select *, row_number() over (partition by label order by vec_id) - 1 as i from embeddings)"


@query(
    f"select district_id, round_id, case when n = {COHORT} then 'complete' else 'deadline' end as status, n, coalesce((select string_agg(a::varchar, ',' order by a) from unnest(range(0, {COHORT})) t(a) where not list_contains(agents, a)), '') as missing from (select district_id, round_id, count(*) as n, list(agent_id) as agents from sent group by all)",
    more={"sent": _UPLOADS},
)
def stream_cohort(spark: SparkSession, d: str) -> DataFrame:
    rounds = drain(_cohorts(spark, d)).where("status <> 'upload'")
    return rounds.select("district_id", "round_id", "status", "n", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query(
    f"""select district_id, round_id, pos, {_r('coalesce(value, 0)', 'value')}, value is not null as contributed
from (select distinct district_id, round_id, unnest(range(0, 64)) as pos from pick) left join
(select district_id, round_id, pos, avg(value) as value from (select *, row_number() over (w order by value, agent_id) as i, count(*) over w as n from have join pick using (district_id, round_id, agent_id) window w as (partition by district_id, round_id, pos)) where i > floor(n * 0.1) and i <= n - floor(n * 0.1) group by 1, 2, 3) using (district_id, round_id, pos)""",
    more={
        "sent": _UPLOADS,
        "present": "select * from (select district_id, round_id, agent_id, vec_id, unnest(range(0, 64)) as pos, unnest(embedding)::double as value from sent) where (vec_id + pos) % 11 <> 0",
        "size": "select district_id, round_id, agent_id, sqrt(sum(value * value)) as l2 from present group by all",
        "have": "select district_id, round_id, agent_id, pos, value * least(1.0, 0.9 / l2) as value from present join size using (district_id, round_id, agent_id)",
        "square": "select g.district_id, g.round_id, a, b, sum((coalesce(x.value, 0) - coalesce(y.value, 0)) ** 2) as distance from (select p.district_id, p.round_id, p.agent_id as a, q.agent_id as b, unnest(range(0, 64)) as pos from size p join size q on p.district_id = q.district_id and p.round_id = q.round_id and p.agent_id <> q.agent_id) g left join have x on (x.district_id, x.round_id, x.agent_id, x.pos) = (g.district_id, g.round_id, a, g.pos) left join have y on (y.district_id, y.round_id, y.agent_id, y.pos) = (g.district_id, g.round_id, b, g.pos) group by 1, 2, 3, 4",
        "near": "select district_id, round_id, a as agent_id, n, sum(distance) as score from (select *, row_number() over (partition by district_id, round_id, a order by distance, b) as r, count(*) over (partition by district_id, round_id, a) + 1 as n from square) where r <= n - 3 and n >= 5 group by all",
        "pick": "select district_id, round_id, agent_id from (select *, row_number() over (partition by district_id, round_id order by score, agent_id) as r from near) where r <= n - 1",
    },
)
def stream_rounds(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    jobs.stream_rounds(_cohorts(spark, d), f"{folder}/out", f"{folder}/state", RoundConfig(clip=0.9)).awaitTermination()
    return _long_pos(spark.read.parquet(f"{folder}/out/deltas").drop("batch"))


@query("select district_id, round_id, round(drift, 6) as drift, n::bigint as stable_rounds, n >= 2 as converged from (select *, count(*) filter (drift < 0.5) over (partition by district_id, run order by round_id) as n from (select *, count(*) filter (not drift < 0.5) over (partition by district_id order by round_id) as run from (select user_id as district_id, event_id as round_id, abs(value - 50) / 50 as drift from events)))")
def stream_convergence(spark: SparkSession, d: str) -> DataFrame:
    drift = _events(spark, d).select(F.col("user_id").alias("district_id"), F.col("event_id").alias("round_id"), (F.abs(F.col("value") - 50) / 50).alias("drift"))
    return drain(jobs.stream_convergence(drift, 0.5, 2))


@query("select user_id % 100 as round_id, event_type as agent_id, max(event_id) as seq from events group by 1, 2")
def stream_outbox(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/outbox-{uuid.uuid4().hex}"
    outbox = Outbox(f"{folder}/out")
    rows = v.table(spark, d, "events").select((F.col("user_id") % 100).alias("round_id"), F.col("event_type").alias("agent_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    once = rows.groupBy("round_id", "agent_id").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"))
    for n in (1, 3):  # the second run has lost its checkpoint and takes other batches: it finds nothing to deliver
        stream = arrivals(once, "seq", ends=False) if n == 1 else spark.readStream.schema(once.schema).parquet(_written(once, folder))
        jobs.stream_outbox(stream, outbox, f"{folder}/state-{n}").awaitTermination()
    return outbox.read(spark).select("round_id", "agent_id", "seq")


def _written(df: DataFrame, folder: str) -> str:
    df.write.parquet(f"{folder}/again")
    return f"{folder}/again"


@query(f"select r.event_id, w.weather_id is not null as has_weather, {_r('w.temperature', 'temperature')} from readings r left join (select * from weather where hour(ts) % 5 <> 0) w on 'W' || (r.household_id % 10) = w.weather_id and date_trunc('hour', r.ts) = w.ts")
def stream_weather_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _arriving(spark, d, weather_id=F.concat(F.lit("W"), (F.col("household_id") % 10).cast("string")))
    hours = v.weather(spark, d).where(F.hour("ts") % 5 != 0).withColumns({"ts": F.col("ts").cast("timestamp"), "seq": F.unix_seconds(F.col("ts").cast("timestamp")) / 3600}).withColumn("seq", F.col("seq").cast("long"))
    joined = jobs.stream_weather_join(rows, arrivals(hours, "seq").drop("seq"), LATENESS, LATENESS)
    return drain(joined).select("event_id", F.col("temperature").isNotNull().alias("has_weather"), "temperature")


@query("select event_id, abs(reward) > 0.5 as journaled from episodes where event_id % 11 = 0 or action not in ('view', 'click')")
def stream_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", ((F.col("value") - 50) / 50).alias("reward"), (F.col("event_id") % 11 == 0).alias("drift"), F.when(F.col("event_type") == "view", "MAINTAIN").when(F.col("event_type") == "click", "MONITOR").otherwise("SHED_EV").alias("action"))
    return drain(jobs.stream_episodes(e).select("event_id", "journaled"))


@query(
    "select event_id, coalesce(ts <= mark - interval 1 hour, false) as late from arrived join (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) as mark from arrived group by part) using (part)",
    more={"arrived": _COME},
)
def late_policy(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    jobs.late_policy(_arriving(spark, d, ends=False), "1 hour", f"{folder}/out", f"{folder}/state").awaitTermination()
    fine, late = (spark.read.parquet(f"{folder}/out/{k}").select("event_id") for k in ("fine", "late"))
    return fine.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
