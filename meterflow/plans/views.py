"""Canonical inputs of the registered queries, from the given tables: as frames, and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("household_id"), "ts", F.col("value").alias("kwh"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("household_id"), "ts", "event_id", F.col("value").alias("kwh"))


def households(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id % 37 <> 36")
    return e.select(F.col("user_id").alias("household_id"), F.concat(F.lit("W"), (F.col("user_id") % 10).cast("string")).alias("weather_id")).distinct()


def weather(spark: SparkSession, d: str) -> DataFrame:
    station = F.concat(F.lit("W"), (F.col("user_id") % 10).cast("string")).alias("weather_id")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return table(spark, d, "events").groupBy(station, hour).agg(F.avg("value").alias("temperature"), F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("humidity"), F.count("*").cast("double").alias("sunshine"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    return prepare.resample_15min(prepare.join_metadata(meter(spark, d), households(spark, d)))


def grid(spark: SparkSession, d: str) -> DataFrame:
    return prepare.gap_fill(slots(spark, d))


def imputed(spark: SparkSession, d: str) -> DataFrame:
    return prepare.causal_impute(grid(spark, d))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    from meterflow.operators.sequence import baseline_forecast

    return baseline_forecast(imputed(spark, d))


def assignments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("household_id")).distinct()
    r = F.col("household_id") % 10
    return e.withColumn("cluster", F.when(r < 6, 0).when(r < 9, 1).otherwise(2))


def updates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("district_id"), F.col("vec_id").alias("agent_id"), F.posexplode("embedding").alias("pos", "value"))
    return e.withColumn("value", F.col("value").cast("double"))


def client_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("district_id"), F.col("vec_id").alias("agent_id"), (1 + F.col("vec_id") % 7).alias("n_samples"))


def coords(spark: SparkSession) -> DataFrame:
    return spark.range(66).select(F.col("id").cast("int").alias("pos"))


def global_w(spark: SparkSession, d: str) -> DataFrame:
    return updates(spark, d).groupBy("pos").agg(F.avg("value").alias("value"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("district_id"), F.col("user_id").alias("agent_id"), F.floor(F.col("event_id") / 1000).alias("round_id"), "value")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("agent_id"), "ts", ((F.col("value") - 50) / 50).alias("reward"), F.col("event_type").alias("action"))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run_group"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("round_id"), F.col("o_orderdate").alias("done_ts"), F.col("o_totalprice").cast("double").alias("wallclock_s"), F.col("o_orderstatus").alias("status"))


def privacy(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_suppkey").alias("agent_id"), (0.5 + 10 * F.col("l_discount").cast("double")).alias("sigma"), F.lit(1.0).alias("sample_rate"))


#: The same inputs for DuckDB, each over the tables and the inputs above it.
SQL = {
    "meter": "select user_id as household_id, ts, value as kwh from events",
    "readings": "select user_id as household_id, ts, event_id, value as kwh from events",
    "households": "select distinct user_id as household_id, 'W' || (user_id % 10) as weather_id from events where user_id % 37 <> 36",
    "weather": "select 'W' || (user_id % 10) as weather_id, date_trunc('hour', ts)::timestamp as ts, avg(value) as temperature, avg(case when event_type <> 'error' then value end) as humidity, count(*)::double as sunshine from events group by 1, 2",
    "joined": "select m.household_id, h.weather_id, m.ts, m.kwh from meter m left join households h using (household_id)",
    "slots": "select household_id, weather_id, time_bucket(interval 15 minutes, ts) as ts, sum(kwh) as kwh from joined group by 1, 2, 3",
    "grid": "select g.household_id, g.weather_id, g.ts, s.kwh from (select household_id, weather_id, unnest(generate_series(min(ts), max(ts), interval 15 minutes)) as ts from slots group by 1, 2) g left join slots s on g.household_id = s.household_id and g.ts = s.ts and g.weather_id is not distinct from s.weather_id",
    "imputed": "select household_id, weather_id, ts, coalesce(kwh, avg(kwh) over (partition by household_id order by ts rows between unbounded preceding and 1 preceding), 0.0) as kwh from grid",
    "forecasts": "select household_id, ts, kwh as y, lag(kwh) over (partition by household_id order by ts) as yhat from imputed",
    "assignments": "select distinct user_id as household_id, case when user_id % 10 < 6 then 0 when user_id % 10 < 9 then 1 else 2 end as cluster from events",
    "updates": "select label::bigint as district_id, vec_id as agent_id, unnest(range(0, 64)) as pos, unnest(embedding)::double as value from embeddings",
    "client_meta": "select label::bigint as district_id, vec_id as agent_id, 1 + vec_id % 7 as n_samples from embeddings",
    "coords": "select unnest(range(0, 66)) as pos",
    "global_w": "select pos, avg(value) as value from updates group by pos",
    "norms": "select district_id, agent_id, sqrt(sum(value * value)) as l2 from updates group by all",
    "clipped": "select u.district_id, u.agent_id, pos, value * (case when l2 > 7.5 then 7.5 / l2 else 1.0 end) as value, l2 from updates u join norms using (district_id, agent_id)",
    "distances": "select x.district_id, x.agent_id as a, y.agent_id as b, sum((x.value - y.value) ** 2) as distance from updates x join updates y on x.district_id = y.district_id and x.pos = y.pos and x.agent_id <> y.agent_id group by all",
    "scores": "select district_id, a as agent_id, sum(distance) as score from (select *, row_number() over (partition by district_id, a order by distance, b) as r, count(*) over (partition by district_id, a) + 1 as n from distances) where r <= n - 1 - 2 group by all",
    "krum": "select *, r <= n - 1 as accepted from (select *, row_number() over (partition by district_id order by score, agent_id) as r, count(*) over (partition by district_id) as n from scores)",
    "uploads": "select event_id as seq, user_id % 10 as district_id, user_id as agent_id, event_id // 1000 as round_id, value from events",
    "episodes": "select event_id, user_id as agent_id, ts, (value - 50) / 50 as reward, event_type as action from events",
    "run_log": "select o_custkey as run_group, o_orderkey as run_id, o_orderkey as round_id, o_orderdate as done_ts, o_totalprice::double as wallclock_s, o_orderstatus as status from orders",
    "privacy": "select l_suppkey as agent_id, 0.5 + 10 * l_discount::double as sigma, 1.0 as sample_rate from lineitem",
}


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """The statement with the inputs that it names, directly or through others."""
    known = SQL | (more or {})
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(known[name])

    visit(body)
    return ("with " + ", ".join(f"{n} as ({known[n]})" for n in known if n in need) + " " if need else "") + body
