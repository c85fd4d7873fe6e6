"""Federated rounds: validate, clip, select, average, gate, apply, audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.operators import report, updates
from meterflow.plans.lineage import settle
from meterflow.sources import writers


@dataclass(frozen=True)
class RoundConfig:
    clip: float = 1.0
    f: int = 1
    trim: float = 0.1
    limit: float = 0.25
    max_parameters: int = 10_000_000


@dataclass(frozen=True)
class RoundResult:
    """Frames of one round: new weights, city delta, audit and the gate's row."""

    weights: DataFrame
    delta: DataFrame
    audit: DataFrame
    gate: DataFrame


def district_deltas(rows: DataFrame, meta: DataFrame, config: RoundConfig, keys: tuple[str, ...] = updates.COHORT, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked trimmed means of accepted agents, audit rows) of each cohort.

    ``places`` are the coordinates of the means: of all cohorts (pos), or of each (keys, pos).
    """
    coords = rows.select("pos").distinct() if places is None else places
    each = [*keys, "agent_id"]
    valid = updates.validate_updates(rows, places, config.max_parameters, tuple(each)).where("reason is null").select(*each)
    # Vectors travel and are kept as bytes, as they were sent; how far each is clipped goes along as its scale.
    kept = updates.packed_agents(rows, tuple(each)).join(valid.join(updates.l2_norm(rows, tuple(each)), each), each)
    clipped = updates.unpacked_agents(settle(kept.withColumn("scale", updates.clip_factor(config.clip))))
    plain = clipped.select(*each, "pos", "value", "scale")
    agents = plain.select(*each).distinct()
    chosen = settle(updates.multi_krum(updates.krum_scores(plain, config.f, keys, agents), config.f, keys=keys))
    rejected = chosen.where("not accepted").select(*each)  # f of each cohort
    accepted = plain.join(F.broadcast(rejected), each, "left_anti")
    value = F.col("value") * F.col("scale")
    norms = clipped.groupBy(*each).agg(F.first("l2").alias("original_l2"), F.sqrt(F.sum(value * value)).alias("clipped_l2"))
    audit = chosen.withColumnRenamed("score", "krum_score").join(norms, each).join(meta, each, "left")
    means = updates.packed_trimmed_mean(accepted, config.trim, keys)
    return updates.over_coords(means, chosen.where("accepted"), coords, keys), audit


def city_delta(districts: DataFrame, audit: DataFrame) -> DataFrame:
    """Mean of the districts' contributed coordinates, weighted by their samples (1 at least)."""
    weight = audit.groupBy("district_id").agg(F.greatest(F.lit(1), F.coalesce(F.sum("n_samples"), F.lit(0))).alias("n_samples"))
    sent = districts.join(weight, "district_id")
    total = F.sum(F.when(F.col("contributed"), F.col("n_samples")))
    mean = F.coalesce(F.sum(F.when(F.col("contributed"), F.col("value") * F.col("n_samples"))) / total, F.lit(0.0))
    return sent.groupBy("pos").agg(mean.alias("value"), total.isNotNull().alias("contributed"))


def federated_round(rows: DataFrame, meta: DataFrame, w: DataFrame, config: RoundConfig | None = None, validator: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> RoundResult:
    """One round over fixed updates (district_id, agent_id, pos, value); what is used more than once is settled.

    The validator takes (weights, candidate) and returns the candidate to use.
    """
    config = config or RoundConfig()
    districts, audit = district_deltas(rows, meta, config)
    delta = settle(city_delta(districts, audit))
    gate = updates.relative_update_gate(w, delta.where("contributed"), config.limit)
    candidate = updates.apply_global_delta(w, delta)
    if validator is not None:
        candidate = validator(w, candidate)
    old = w.select("pos", F.col("value").alias("old"))
    new = candidate.join(old, "pos").crossJoin(F.broadcast(gate.select("accepted"))).select("pos", F.when(F.col("accepted"), F.col("value")).otherwise(F.col("old")).alias("value"))
    return RoundResult(new, delta, audit, gate)


def with_feedback(rows: DataFrame, residuals: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(sent, residuals after): agents of this round send the largest values with what they held back before.

    An agent that sends nothing in this round keeps its residual.
    """
    agent = list(updates.AGENT)
    present = rows.select(*agent).distinct()
    total = updates.with_residuals(rows, residuals.join(present, agent, "left_semi"))
    marked = settle(updates.topk_sparsify(total, ratio))
    idle = residuals.join(present, agent, "left_anti")
    return marked.where("kept").drop("kept"), marked.where("not kept").drop("kept").unionByName(idle)


def federated_run(w: DataFrame, meta: DataFrame, make_updates: Callable[[DataFrame, int], DataFrame], path: str, rounds: int, eps: float, patience: int, config: RoundConfig | None = None, start: int = 1, ratio: float | None = None) -> DataFrame:
    """Rounds until converged; each round's weights are written and read again, so that plans stay short.

    With a ratio, updates are cut to their largest values, and what is held back is kept by agent and
    coordinate in path/residuals, a version for each round beside its weights.  A run that starts at a later
    round goes on from the weights and residuals of the round before, as they are on disk (``w`` is then
    not used).  Returns (round_id, drift, accepted), one row per round.
    """
    spark = w.sparkSession
    if start == 1:
        writers.checkpoint_round(w, path, 0)
        if ratio is not None:
            writers.checkpoint_round(spark.createDataFrame([], "district_id bigint, agent_id bigint, pos int, value double"), f"{path}/residuals", 0)
    log, stable = [], 0
    for i in range(start, start + rounds):
        now = writers.resume_round(spark, path, i)
        rows = make_updates(now, i)
        if ratio is not None:
            rows, after = with_feedback(rows, writers.resume_round(spark, f"{path}/residuals", i), ratio)
            writers.checkpoint_round(after, f"{path}/residuals", i)
        result = federated_round(rows, meta, now, config)
        writers.checkpoint_round(result.weights, path, i)
        drift = updates.state_drift(now, writers.resume_round(spark, path, i + 1)).first()["drift"]
        log.append((i, float(drift or 0.0), bool(result.gate.first()["accepted"])))
        stable = stable + 1 if log[-1][1] < eps else 0
        if stable >= patience:
            break
    return spark.createDataFrame(log, "round_id int, drift double, accepted boolean")


def epsilon_ledger(events: DataFrame, delta: float = 1e-5, budget: float | None = None, key: str = "agent_id") -> DataFrame:
    """Epsilon spent per agent by basic composition; events without noise spend nothing.

    Delta must lie in (0, 1), and the ``sample_rate`` of each event, where there is one, in (0, 1].
    """
    if not 0 < delta < 1:
        raise ValueError("delta must be in (0, 1)")
    if "sample_rate" in events.columns:
        sound = F.coalesce((F.col("sample_rate") > 0) & (F.col("sample_rate") <= 1), F.lit(False))
        events = events.where(F.assert_true(sound, F.lit("sample_rate must be in (0, 1]")).isNull())
    spent = events.where("sigma > 0").groupBy(key).agg(F.count("*").alias("n_events"), (F.sum(1 / F.col("sigma")) * F.sqrt(2 * F.log(1.25 * F.count("*") / delta))).alias("epsilon"))
    out = events.select(key).distinct().join(spent, key, "left").fillna({"n_events": 0, "epsilon": 0.0})
    return out if budget is None else out.withColumn("within_budget", F.col("epsilon") <= budget)


def round_summaries(audit: DataFrame, config: RoundConfig) -> DataFrame:
    return report.district_round_summary(audit, {"clip_threshold": config.clip, "trim_ratio": config.trim, "f_byzantine": float(config.f)})
