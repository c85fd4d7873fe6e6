"""The feature job: raw readings to complete, clean and labelled feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterflow.operators import cohort, prepare
from meterflow.plans.lineage import settle
from meterflow.sources import readers, writers

#: The order of the features, the target first.
BASE = ["kwh", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "temperature", "humidity", "sunshine", "weather_missing", "load_missing"]
EXTENDED = [*BASE, "lag_1", "lag_4", "lag_96", "roll_mean_4", "roll_std_4", "roll_max_96"]


def filled(meter: DataFrame, households: DataFrame, weather: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row per household and slot, complete, with flags for what was missing.

    Households are chosen before anything is shuffled.
    """
    if manifest is not None:
        meter = prepare.cohort_filter(meter, manifest)
    slots = prepare.gap_fill(prepare.resample_15min(prepare.join_metadata(meter, households)))
    hourly = prepare.dedupe_avg(weather, ["weather_id", "ts"], list(prepare.WEATHER))
    joined = prepare.missing_flags(prepare.null_nonfinite(prepare.weather_hour_join(slots, hourly), ["kwh", *prepare.WEATHER]))
    return prepare.fill_defaults(prepare.causal_impute(joined), dict.fromkeys(prepare.WEATHER, 0.0))


def features(meter: DataFrame, households: DataFrame, weather: DataFrame, manifest: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """One row per household and slot with all features; the windows by household share one sort.

    Winsorising bounds are those of the whole series, or are given (household_id, lo, hi).  The former are one
    more window by household, so that complete rows are neither written nor shuffled.
    """
    rows = filled(meter, households, weather, manifest)
    cut = prepare.with_winsor_bounds(rows) if bounds is None else prepare.quantile_join(rows, bounds)
    bounded = prepare.clip_bounds(cut, "kwh", "lo", "hi")
    return prepare.rolling_features(prepare.lag_features(prepare.calendar_features(bounded))).select(prepare.HOUSEHOLD, "weather_id", "ts", *EXTENDED)


def etl_job(spark: SparkSession, meter: str, weather: str, households: str, root: str, run_id: str, tz: str = "UTC", manifest: str | None = None) -> str:
    """Reads the files, builds features, refuses rows that are not finite, publishes a version; its folder."""
    chosen = readers.read_manifest(spark, manifest) if manifest else None
    made = settle(features(readers.read_meter(spark, meter, tz), readers.read_households(spark, households), readers.read_weather(spark, weather, tz), chosen))
    return writers.publish_version(prepare.finite_gate(made, EXTENDED), root, run_id)


def sampling_job(spark: SparkSession, meter: DataFrame, n: int, k: int, seed: int, out: str) -> DataFrame:
    """Profiles, clusters and a balanced cohort; writes the profiles and the manifest."""
    from meterflow.plans.learn import adaptive_k

    assigned = adaptive_k(settle(cohort.household_profile(meter)), k, seed)
    assigned.write.mode("overwrite").parquet(f"{out}/profiles")
    chosen = cohort.balanced_select(spark.read.parquet(f"{out}/profiles"), n, seed)
    writers.write_manifest(chosen, f"{out}/manifest")
    return chosen
