"""Meter and weather readings made regular, complete and clean."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.columns import calendar, finite, safe_float

HOUSEHOLD = "household_id"
WEATHER = ("temperature", "humidity", "sunshine")


# --- scalar and filter


def normalize_tz(df: DataFrame, column: str, tz: str) -> DataFrame:
    """Naive local time to UTC, by the zone's daylight rules; text with an offset is not shifted again."""
    kind = dict(df.dtypes)[column]
    if kind != "string":
        return df.withColumn(column, F.to_utc_timestamp(F.col(column).cast("timestamp"), tz))
    offset = F.col(column).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    utc = F.try_to_timestamp(F.col(column))
    return df.withColumn(column, F.when(offset, utc).otherwise(F.to_utc_timestamp(utc, tz)))


def null_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({c: finite(c) for c in columns})


def missing_flags(df: DataFrame, load: str = "kwh", weather: tuple[str, ...] = WEATHER) -> DataFrame:
    """load_missing and weather_missing (any reading null), before anything is filled."""
    gone = F.greatest(*[F.col(c).isNull().cast("int") for c in weather])
    return df.withColumns({"load_missing": F.col(load).isNull().cast("int"), "weather_missing": gone})


def stream_weather_missing(df: DataFrame, weather: tuple[str, ...] = WEATHER) -> DataFrame:
    """The agents' rule: weather counts as missing when all readings are exactly zero."""
    zero = F.lit(True)
    for c in weather:
        zero = zero & (F.coalesce(F.col(c), F.lit(1.0)) == 0.0)
    return df.withColumn("weather_missing", zero.cast("int"))


def fill_defaults(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna(values)


def calendar_features(df: DataFrame, ts: str = "ts", tz: str = "UTC") -> DataFrame:
    """Circular hour and weekday, weekend flag; in another zone if asked."""
    at = F.col(ts) if tz == "UTC" else F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    return df.withColumns(calendar(at))


def clip_bounds(df: DataFrame, column: str, lo: str, hi: str) -> DataFrame:
    """Clips to [max(lo, 0), hi] where hi exceeds that lower bound."""
    low = F.greatest(F.col(lo), F.lit(0.0))
    return df.withColumn(column, F.when(F.col(hi) > low, F.least(F.greatest(F.col(column), low), F.col(hi))).otherwise(F.col(column)))


def to_float(df: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    return df.withColumn(column, safe_float(column, default))


# --- joins


def join_metadata(meter: DataFrame, households: DataFrame) -> DataFrame:
    """Left join on the household: readings without metadata keep a null weather_id."""
    return meter.join(households, HOUSEHOLD, "left")


def cohort_filter(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Readings of the manifest's households only."""
    return df.join(manifest.select(HOUSEHOLD).distinct(), HOUSEHOLD, "left_semi")


def first_n_households(df: DataFrame, n: int) -> DataFrame:
    """Readings of the first n households in order of their id as text."""
    chosen = df.select(HOUSEHOLD).distinct().orderBy(F.col(HOUSEHOLD).cast("string")).limit(n)
    return df.join(chosen, HOUSEHOLD, "left_semi")


def resample_15min(df: DataFrame, width: str = "15 minutes", keys: tuple[str, ...] = (HOUSEHOLD, "weather_id")) -> DataFrame:
    """Sum of kwh per slot; a slot of nulls only stays null."""
    return df.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.sum("kwh").alias("kwh")).select(*keys, F.col("w.start").alias("ts"), "kwh")


def time_bounds(df: DataFrame) -> DataFrame:
    return df.groupBy(HOUSEHOLD).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Rows of a part of filled slots, on average.
FILLED = 1_000_000


def filled_parts(slots: DataFrame, step: str = "15 minutes") -> int:
    """How many parts of FILLED rows the slots make once their gaps are filled; only this count comes to the driver."""
    first, last, width = (F.unix_micros(F.expr(x).cast("timestamp")) for x in ("min(ts)", "max(ts)", f"timestamp '1970-01-01 00:00:00' + interval {step}"))
    runs = slots.groupBy(HOUSEHOLD, "weather_id").agg(((last - first) / width + 1).alias("n"))
    return ceil((runs.agg(F.sum("n").alias("n")).first()["n"] or 0) / FILLED)


def gap_fill(slots: DataFrame, step: str = "15 minutes", also: tuple[str, ...] = ()) -> DataFrame:
    """Every slot between the first and last one of a household and weather id, a null id too.

    Columns in ``also`` go along with each slot to those that fill its gap.

    Each slot fills the gap up to the next one, so that no grid is joined, and rows stay
    partitioned by household for the windows that follow.  The slots' own size says nothing of that of the gaps, so
    that the filled rows are counted first: their parts are as many as shuffles have, and more where those would
    hold over ``FILLED`` rows on average, as each window sorts a part.
    """
    parts = max(int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions")), filled_parts(slots, step))
    slots = slots.repartition(parts, HOUSEHOLD)
    order = Window.partitionBy(HOUSEHOLD).orderBy("weather_id", "ts")
    follows = F.when(F.lead("weather_id").over(order).eqNullSafe(F.col("weather_id")), F.lead("ts").over(order))
    ahead = slots.select(HOUSEHOLD, "weather_id", "ts", "kwh", *also, follows.alias("next_ts"))
    run = F.expr(f"sequence(ts, coalesce(next_ts - interval {step}, ts), interval {step})")
    filled = ahead.select(HOUSEHOLD, "weather_id", "kwh", *also, F.posexplode(run).alias("place", "ts"))
    return filled.select(HOUSEHOLD, "weather_id", "ts", F.when(F.col("place") == 0, F.col("kwh")).alias("kwh"), *also)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dedupe_avg(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the mean of each column."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def weather_hour_join(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Attaches the reading of the hour that contains each slot."""
    hourly = weather.withColumnRenamed("ts", "hour_ts")
    return df.withColumn("hour_ts", F.date_trunc("hour", "ts").cast(dict(weather.dtypes)["ts"])).join(hourly, ["weather_id", "hour_ts"], "left").drop("hour_ts")


def weather_asof_join(df: DataFrame, weather: DataFrame, bounded: bool = True) -> DataFrame:
    """Attaches the last reading at or before each slot; none after the station's last reading if bounded.

    A station may serve very many households, so that readings are first carried to each
    (station, slot) and joined back, rather than ordering all households' rows together.
    """
    slots = df.select("weather_id", "ts").where("weather_id is not null").distinct()
    reading = F.struct("ts", *WEATHER)
    both = slots.select("weather_id", "ts", F.lit(None).cast(f"struct<ts:{dict(weather.dtypes)['ts']},temperature:double,humidity:double,sunshine:double>").alias("r"), F.lit(1).alias("source"))
    both = both.unionByName(weather.select("weather_id", "ts", reading.alias("r"), F.lit(0).alias("source")))
    order = Window.partitionBy("weather_id").orderBy("ts", "source")
    carried = both.withColumn("r", F.last("r", ignorenulls=True).over(order)).where("source = 1")
    if bounded:
        last = weather.groupBy("weather_id").agg(F.max("ts").alias("last_ts"))
        carried = carried.join(last, "weather_id", "left").withColumn("r", F.when(F.col("ts") <= F.col("last_ts"), F.col("r")))
    return df.join(carried.select("weather_id", "ts", *[F.col(f"r.{c}").alias(c) for c in WEATHER]), ["weather_id", "ts"], "left")


def quantile_join(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with their household's bounds."""
    return df.join(bounds, HOUSEHOLD, "left")


# --- imputation and bounds


def _past(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def causal_impute(df: DataFrame, column: str = "kwh") -> DataFrame:
    """Nulls become the mean of strictly earlier observations of the household, else 0."""
    before = F.avg(column).over(_past(HOUSEHOLD).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(column, F.coalesce(F.col(column), before, F.lit(0.0)))


def ffill_impute(df: DataFrame, column: str = "kwh") -> DataFrame:
    """Nulls become the last observation, else 0."""
    last = F.last(column, ignorenulls=True).over(_past(HOUSEHOLD).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(column, F.coalesce(last, F.lit(0.0)))


def winsor_bounds(df: DataFrame, lo: float = 0.001, hi: float = 0.999, accuracy: int = 10000, bounds_from: DataFrame | None = None) -> DataFrame:
    """Approximate per-household quantiles, of another frame (a training cut) if given."""
    source = df if bounds_from is None else bounds_from
    q = F.percentile_approx("kwh", [lo, hi], accuracy)
    return source.groupBy(HOUSEHOLD).agg(q.alias("q")).select(HOUSEHOLD, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


#: Size of a quantile sketch: the rank of a quantile is off by 0.08 % at most, with 99 % confidence.
SKETCH = 4096


def quantile_sketches(df: DataFrame, k: int = SKETCH, by: tuple[str, ...] = ()) -> DataFrame:
    """(household_id, by, sketch): a KLL sketch of each household's finite values, of a few kilobytes however many there are.

    With ``by`` a household has a sketch for each of their values, all from one reading.
    """
    return df.where(finite("kwh").isNotNull()).groupBy(HOUSEHOLD, *by).agg(F.kll_sketch_agg_double("kwh", k).alias("sketch"))


def merge_sketches(*tables: DataFrame) -> DataFrame:
    """The sketches of all values that any row of the tables has seen: a day's are added without its history."""
    return reduce(DataFrame.unionByName, [t.select(HOUSEHOLD, "sketch") for t in tables]).groupBy(HOUSEHOLD).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_bounds(sketches: DataFrame, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Quantiles of each household from its sketch."""
    return sketches.select(HOUSEHOLD, *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(k) for k, q in (("lo", lo), ("hi", hi))])


def with_winsor_bounds(df: DataFrame, lo: float = 0.001, hi: float = 0.999, accuracy: int = 10000) -> DataFrame:
    """The rows with their own household's bounds, from one pass over the household's rows: no join, no second reading."""
    q = F.percentile_approx("kwh", [lo, hi], accuracy).over(Window.partitionBy(HOUSEHOLD))
    return df.withColumn("_q", q).withColumns({"lo": F.col("_q")[0], "hi": F.col("_q")[1]}).drop("_q")


def winsor_exact(df: DataFrame, lo: float = 0.001, hi: float = 0.999, min_n: int = 10) -> DataFrame:
    """Interpolated quantiles, null for households of fewer than min_n finite values."""
    x = finite("kwh")
    n = F.count(x)
    return df.groupBy(HOUSEHOLD).agg(n.alias("n"), *[F.when(n >= min_n, F.percentile(x, q)).alias(k) for k, q in (("lo", lo), ("hi", hi))])


# --- features


def lag_features(df: DataFrame, lags: tuple[int, ...] = (1, 4, 96)) -> DataFrame:
    """Earlier values; the own value where there is none yet."""
    w = _past(HOUSEHOLD)
    return df.withColumns({f"lag_{n}": F.coalesce(F.lag("kwh", n).over(w), F.col("kwh")) for n in lags})


def running_max(df: DataFrame, n: int, column: str = "kwh", out: str = "roll_max") -> DataFrame:
    """The largest of the last n values of each row's household, its own included, in two passes.

    The first takes the largest of about sqrt(n) values, the second that of about sqrt(n) such runs, so that no
    frame is read again for each row and the rows are buffered twice only.
    """
    w, short = _past(HOUSEHOLD), max(1, round(n**0.5))
    largest = lambda c, steps: F.greatest(F.col(c), *[F.lag(c, k).over(w) for k in steps]) if steps else F.col(c)
    runs = sorted({*range(short, n - short, short), n - short} - {0})
    return df.withColumn(out, largest(column, range(1, short))).withColumn(out, largest(out, [k for k in runs if k > 0]))


def rolling_features(df: DataFrame) -> DataFrame:
    """Mean and population deviation of 4 rows, maximum of 96, each with the current row."""
    four = _past(HOUSEHOLD).rowsBetween(-3, 0)
    return running_max(df.withColumns({"roll_mean_4": F.avg("kwh").over(four), "roll_std_4": F.stddev_pop("kwh").over(four)}), 96, out="roll_max_96")


def lag_features_backfill(df: DataFrame, lags: tuple[int, ...] = (1, 4, 96)) -> DataFrame:
    """The variant with the household's first value before the start, and sample deviations (0 for one row)."""
    w = _past(HOUSEHOLD)
    first = F.first("kwh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    four = w.rowsBetween(-3, 0)
    out = {f"lag_{n}": F.coalesce(F.lag("kwh", n).over(w), first) for n in lags}
    return running_max(df.withColumns(out | {"roll_mean_4": F.avg("kwh").over(four), "roll_std_4": F.coalesce(F.stddev_samp("kwh").over(four), F.lit(0.0))}), 96, out="roll_max_96")


# --- data quality


def table_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(HOUSEHOLD).alias("n_households"))


def dq_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row: ``<stage>_rows``, ``_households``, ``_null_kwh``, and ``_load_missing`` and ``_weather_missing`` where a stage has these flags.

    All stages are counted in one aggregate, so that what they have in common is shuffled once.
    """
    if not stages:
        raise ValueError("no stages")
    flags, parts, columns = ("load_missing", "weather_missing"), [], []
    for i, (name, df) in enumerate(stages.items()):
        have = [F.col(c).cast("long").alias(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in flags]
        parts.append(df.select(F.lit(i).alias("stage"), F.col(HOUSEHOLD), F.col("kwh").isNull().alias("no_kwh"), *have))
        columns += [(i, f"{name}_rows", "n"), (i, f"{name}_households", "households"), (i, f"{name}_null_kwh", "no_kwh")] + [(i, f"{name}_{c}", c) for c in flags if c in df.columns]
    together = reduce(DataFrame.unionByName, parts)
    per = together.groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct(HOUSEHOLD).alias("households"), F.count_if("no_kwh").alias("no_kwh"), *[F.sum(c).alias(c) for c in flags])
    return per.agg(*[F.coalesce(F.max(F.when(F.col("stage") == i, F.col(c))), F.lit(0)).alias(out) for i, out, c in columns])


def dq_ratios(counts: DataFrame, raw: str = "raw", final: str = "out") -> DataFrame:
    """Null ratios, retention and, where missing weather was counted, its coverage; divisions guarded by at least one row."""
    at_least = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    ratios = [
        (F.col(f"{raw}_null_kwh") / at_least(f"{raw}_rows")).alias("null_ratio_before"),
        (F.col(f"{final}_null_kwh") / at_least(f"{final}_rows")).alias("null_ratio_after"),
        (F.col(f"{final}_households") / at_least(f"{raw}_households")).alias("household_retention"),
    ]
    if f"{final}_weather_missing" in counts.columns:
        ratios.append(((at_least(f"{final}_rows") - F.col(f"{final}_weather_missing")) / at_least(f"{final}_rows")).alias("weather_coverage"))
    return counts.select(*ratios)


def require_columns(df: DataFrame, required: list[str], label: str = "table") -> DataFrame:
    """The frame, or an error that names the label, what is missing and what there is."""
    missing = schema_difference(df, required)
    if missing:
        raise ValueError(f"{label}: missing columns {missing}; found {sorted(df.columns)}")
    return df


def schema_difference(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def finite_gate(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, or an error with the number of rows that hold a null, NaN or infinity."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | finite(c).isNull()
    n = df.where(bad).count()
    if n:
        raise ValueError(f"{n} rows are not finite in {columns}")
    return df
