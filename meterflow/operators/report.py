"""Round summaries, roll-ups of runs and benchmark figures."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def district_round_summary(audit: DataFrame, params: dict[str, float], expected: DataFrame | None = None, keys: tuple[str, ...] = ("district_id", "round_id")) -> DataFrame:
    """One row per district and round; zeros for expected ones without audit rows.

    audit: keys, agent_id, accepted, n_samples, krum_score, original_l2, clipped_l2.
    """
    n, ok = F.count("*"), F.count_if(F.col("accepted"))
    score = F.col("krum_score")
    made = audit.groupBy(*keys).agg(
        n.alias("n_agents_total"), ok.alias("n_agents_accepted"), (n - ok).alias("n_agents_rejected"), F.sum("n_samples").alias("n_samples_total"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("n_samples"))), F.lit(0)).alias("n_samples_accepted"), (ok / n).alias("acceptance_rate"),
        F.avg(score).alias("krum_score_mean"), F.stddev_pop(score).alias("krum_score_std"), F.min(score).alias("krum_score_min"), F.max(score).alias("krum_score_max"),
        F.avg("original_l2").alias("original_l2_mean"), F.avg("clipped_l2").alias("clipped_l2_mean"),
    )
    if expected is not None:
        made = expected.select(*keys).distinct().join(made, list(keys), "left").fillna(0).fillna(0.0)
    return made.withColumns({k: F.lit(v) for k, v in params.items()})


def city_round_summary(districts: DataFrame, expected: int) -> DataFrame:
    """One row per round over (round_id, district_id, n_samples_total, drift)."""
    pairs = F.array_sort(F.collect_list(F.struct("district_id", "n_samples_total")))
    drift = F.max(F.when(~F.isnan("drift") & (F.abs("drift") != float("inf")), F.col("drift")))
    out = districts.groupBy("round_id").agg(F.countDistinct("district_id").alias("participating_districts"), F.array_sort(F.collect_set("district_id")).alias("district_ids"), F.map_from_entries(pairs).alias("samples_by_district"), F.sum("n_samples_total").alias("n_samples_total"), F.coalesce(drift, F.lit(0.0)).alias("drift"))
    return out.withColumn("complete", F.col("participating_districts") == expected)


def building_rollup(counters: DataFrame, columns: list[str]) -> DataFrame:
    """One row: sums of counters and the merged action map."""
    sums = counters.agg(*[F.sum(c).alias(c) for c in columns])
    merged = counters.select(F.explode("action_counts").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("action_counts"))
    return sums.crossJoin(merged)


def audit_rollup(districts: DataFrame, city: DataFrame) -> DataFrame:
    """Totals over district rows beside the latest city row."""
    totals = districts.agg(F.sum("n_agents_accepted").alias("accepted"), F.sum("n_agents_rejected").alias("rejected"), F.sum("n_samples_total").alias("samples"))
    latest = city.agg(F.max_by(F.struct(*city.columns), "round_id").alias("last")).select(F.col("last.round_id").alias("last_round"), F.col("last.drift").alias("last_drift"), F.col("last.participating_districts").alias("last_districts"))
    return totals.crossJoin(latest)


def run_latency_summary(rounds: DataFrame, keys: tuple[str, ...] = ("run_group",)) -> DataFrame:
    """Rounds, total and quantiles of wall time, rounds per second, and the last round's status."""
    n, total = F.count("*"), F.sum("wallclock_s")
    q = F.percentile("wallclock_s", F.array(F.lit(0.5), F.lit(0.95)))
    out = rounds.groupBy(*keys).agg(n.alias("n_rounds"), total.alias("total_s"), q.alias("q"), F.try_divide(n, total).alias("rounds_per_s"), F.max_by("status", "round_id").alias("final_status"))
    return out.select(*keys, "n_rounds", "total_s", F.col("q")[0].alias("p50_s"), F.col("q")[1].alias("p95_s"), "rounds_per_s", "final_status")


def etl_retention(r: DataFrame) -> DataFrame:
    """Shares of rows and households that the feature job kept; null where there were none."""
    return r.select("*", F.try_divide("out_rows", "raw_rows").alias("rows_retained"), F.try_divide("out_households", "raw_households").alias("households_retained"))


def sampling_reduction(r: DataFrame) -> DataFrame:
    """Left-out share of the population; null for an empty one."""
    return r.select("*", (1 - F.try_divide("selected", "population")).alias("reduction_ratio"), (F.col("population") - F.col("selected")).alias("left_out"))


def training_rollup(p: DataFrame, e: DataFrame) -> DataFrame:
    """The last stage of each training report with its gains over the baselines, rounded to six places.

    p: run_id, stages array<struct<name, mae>>, n_windows; e: run_id, mae, persistence_mae, seasonal_mae.
    """
    last = p.select("run_id", "n_windows", F.try_element_at("stages", F.lit(-1)).alias("last"))
    gain = lambda c: F.round(F.col(c) - F.col("mae"), 6).alias(c.replace("_mae", "_delta"))
    return last.join(e, "run_id", "left").select("run_id", "n_windows", F.col("last.name").alias("last_stage"), F.round("last.mae", 6).alias("stage_mae"), gain("persistence_mae"), gain("seasonal_mae"))


def run_rollup(a: DataFrame, b: DataFrame) -> DataFrame:
    """One schema over reports of rounds and reports of ticks."""
    return a.withColumn("kind", F.lit("rounds")).unionByName(b.withColumn("kind", F.lit("ticks")), allowMissingColumns=True)


def latest_run(runs: DataFrame, keys: tuple[str, ...] = ("run_group",)) -> DataFrame:
    """The newest run of each group by completion, or else by its directory's time."""
    when = F.coalesce("done_ts", "dir_ts")
    return runs.groupBy(*keys).agg(F.max_by(F.struct("run_id", when.alias("finished_at")), F.struct(when, F.col("run_id"))).alias("last")).select(*keys, "last.*")


def sweep_table(spark: SparkSession, configs: list[dict], runner: Callable[[dict], DataFrame], at_once: int = 4) -> DataFrame:
    """(i, config, status, error, seconds, figures): one row for each configuration; a failed one, whatever it failed of, keeps its error.

    The runner gives a frame of one row of figures for a configuration; Spark computes some of them at
    once, so that the cluster is not idle while one of them ends.  Only figures come to the driver.
    """
    def one(numbered: tuple[int, dict]) -> tuple:
        i, config = numbered
        began = time.monotonic()
        try:
            row = runner(config).first()
            return i, json.dumps(config, sort_keys=True, default=str), "ok", None, time.monotonic() - began, {k: float(v) for k, v in row.asDict().items() if v is not None}
        except Exception as error:  # noqa: BLE001  (the sweep goes on)
            return i, json.dumps(config, sort_keys=True, default=str), "failed", f"{type(error).__name__}: {error}"[:500], time.monotonic() - began, None

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), enumerate(configs)))
    return spark.createDataFrame(rows, "i int, config string, status string, error string, seconds double, figures map<string,double>")


def json_encode_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def parse_props(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of a JSON text column; null where it does not parse."""
    return df.withColumn("parsed", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "parsed.*")


def dq_report(counts: DataFrame, ratios: DataFrame, layout: DataFrame) -> dict[str, str]:
    """JSON and Markdown of one-row frames of counts, ratios and layout."""
    row = counts.crossJoin(ratios).crossJoin(layout)
    text = row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]
    first = row.first().asDict()
    return {"json": text, "markdown": "\n".join(["| measure | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in first.items()]])}


def bench_report(etl: DataFrame | None = None, sampling: DataFrame | None = None, training: tuple[DataFrame, DataFrame] | None = None, simulation: tuple[DataFrame, DataFrame] | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(section, run_group, body): summaries of the jobs' reports in one frame, each row's figures as JSON.

    etl, sampling: reports for ``etl_retention`` and ``sampling_reduction``; training: the two frames of
    ``training_rollup``; simulation: those of ``run_rollup``; runs: (run_group, run_id, done_ts, dir_ts), of
    which the latest is named.  What is not given, like a run without a report, has no rows.
    """
    made: dict[str, DataFrame] = {}
    if etl is not None:
        made["etl"] = etl_retention(etl)
    if sampling is not None:
        made["sampling"] = sampling_reduction(sampling)
    if training is not None:
        made["training"] = training_rollup(*training).withColumnRenamed("run_id", "run_group")
    if simulation is not None:
        made["simulation"] = run_rollup(*simulation)
    if runs is not None:
        made["sources"] = latest_run(runs)
    if not made:
        raise ValueError("no reports")
    parts = []
    for name, df in made.items():
        group = F.col("run_group").cast("string") if "run_group" in df.columns else F.lit(None).cast("string")
        parts.append(df.select(F.lit(name).alias("section"), group.alias("run_group"), F.to_json(F.struct(*[c for c in df.columns if c != "run_group"])).alias("body")))
    return reduce(DataFrame.unionByName, parts)
