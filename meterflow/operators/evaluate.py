"""Forecast errors, peak events, losses, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.columns import huber
from meterflow.operators import series


def _known(f: DataFrame) -> DataFrame:
    return f.where("y is not null and yhat is not null")


def _error() -> Column:
    return F.col("yhat") - F.col("y")


def _error_sums() -> list[Column]:
    e = _error()
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst")]


def _with_r2(out: DataFrame) -> DataFrame:
    return out.withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(float("nan"))).drop("sse", "sst")


def error_metrics(f: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and R squared (NaN without variance) over rows with both values."""
    return _with_r2(_known(f).groupBy(*by).agg(*_error_sums()))


def _peak(column: str, threshold: float) -> Column:
    """Whether a value reaches the threshold, at six places: the last bit of a sum decides nothing."""
    return F.round(column, 6) >= threshold


def _peak_counts(threshold: float) -> list[Column]:
    t, p = _peak("y", threshold), _peak("yhat", threshold)
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]


def _with_f1(counts: DataFrame) -> DataFrame:
    scored = counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    return scored.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def peak_event_metrics(f: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts at a threshold, precision, recall and F1 (null where undefined)."""
    return _with_f1(_known(f).groupBy(*by).agg(*_peak_counts(threshold)))


def smooth_l1(f: DataFrame) -> DataFrame:
    return _known(f).agg(F.avg(huber(_error())).alias("loss"))


def _peak_loss(threshold: float, weight: float) -> Column:
    w = F.when(_peak("y", threshold), weight).otherwise(1.0)
    return F.sum(huber(_error()) * w) / F.greatest(F.sum(w), F.lit(1.0))


def peak_weighted_loss(f: DataFrame, threshold: float, weight: float = 3.0) -> DataFrame:
    """Smooth L1 with a weight on true peaks, over the total weight (1 at least)."""
    return _known(f).agg(_peak_loss(threshold, weight).alias("loss"))


def _blended(threshold: float, weight: float, lam: float) -> Column:
    if not 0 <= lam <= 1:
        raise ValueError("lam must be in [0, 1]")
    return ((1 - lam) * F.avg(huber(_error())) + lam * _peak_loss(threshold, weight)).alias("loss")


def blended_peak_loss(f: DataFrame, threshold: float, weight: float = 3.0, lam: float = 0.25) -> DataFrame:
    """(1 - lam) smooth L1 + lam peak-weighted loss."""
    return _known(f).agg(_blended(threshold, weight, lam))


#: Losses by name.
LOSSES = {"smooth_l1": smooth_l1, "peak_weighted": peak_weighted_loss, "blended": blended_peak_loss}


def horizon_kl(f: DataFrame, temperature: float = 2.0, alpha: float = 0.5) -> DataFrame:
    """Rows (window_id, step, student, teacher, target) -> task loss, T^2 KL(teacher || student) and their blend."""
    if temperature <= 0 or not 0 <= alpha <= 1:
        raise ValueError("temperature must be positive and alpha in [0, 1]")
    w = Window.partitionBy("window_id")

    def log_softmax(c: str) -> Column:
        x = F.col(c) / temperature
        shifted = x - F.max(x).over(w)
        return shifted - F.log(F.sum(F.exp(shifted)).over(w))

    logs = f.withColumns({"q": log_softmax("student"), "p": log_softmax("teacher")})
    per = logs.groupBy("window_id").agg(F.sum(F.exp("p") * (F.col("p") - F.col("q"))).alias("kl"), F.sum(huber(F.col("student") - F.col("target"))).alias("task"), F.count("*").alias("n"))
    total = per.agg((F.avg("kl") * temperature**2).alias("kl_loss"), (F.sum("task") / F.sum("n")).alias("task_loss"))
    return total.withColumn("total_loss", (1 - alpha) * F.col("task_loss") + alpha * F.col("kl_loss"))


#: Quantiles of past errors that intervals are drawn from.
QUANTILES = 1001
#: Points that a summary of values is thinned to, values that are thinned at once, and groups that summaries meet in.
POINTS, GATHERED, MET = 2**14, 2**20, 64


def _thinned(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values in order with whole weights: all of them, or the middle one of each of POINTS runs of one weight."""
    x, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(x, kind="stable")
    x, weight = x[order], weight[order]
    if len(x) <= POINTS:
        return x, weight
    upto = np.cumsum(weight)
    ends = np.arange(POINTS + 1) * int(upto[-1]) // POINTS
    middle = (ends[:-1] + ends[1:] + 1) // 2
    return x[np.searchsorted(upto, middle)], np.diff(ends)


def _summed_up(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """One summary of all parts, which are thinned as soon as they are GATHERED values."""
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for part in parts:
        levels[0].append(part)
        for k, more in ((0, levels[1]), (1, None)):
            if sum(len(x) for x, _ in levels[k]) >= GATHERED:
                whole = _thinned(levels[k])
                levels[k].clear()
                (levels[k] if more is None else more).append(whole)
    left = levels[0] + levels[1]
    return _thinned(left) if left else None


def _points(part: int, made: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    if made is not None:
        yield pa.record_batch([pa.repeat(pa.scalar(part, pa.int32()), len(made[0])), pa.array(made[0]), pa.array(made[1])], names=["part", "x", "weight"])


def _read(values: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The points of a task's values, as rows of POINT."""
    yield from _points(TaskContext.get().partitionId() % MET, _summed_up((x, np.ones(len(x), np.int64)) for x in values if len(x)))


POINT = "part int, x double, weight long"


def _quantiles(points: DataFrame) -> np.ndarray:
    """QUANTILES values at even ranks of what the points stand for, off by 0.02 % of the rows at most; none for no values.

    Tasks and then MET groups thin their values to points, so that no task merges a summary of each partition, and
    only the quantiles come to the driver.
    """
    met = lambda batches: _summed_up((rows.column("x").to_numpy(), rows.column("weight").to_numpy()) for rows in batches if len(rows))

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _points(key[0].as_py(), met(batches))

    def cut(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, weight = met(batches)
        upto, steps = np.cumsum(weight), QUANTILES - 1
        ranks = np.maximum(1, -(-np.arange(QUANTILES) * int(upto[-1]) // steps))
        yield pa.record_batch([pa.array(np.arange(QUANTILES)), pa.array(x[np.searchsorted(upto, ranks)])], names=["place", "x"])

    parts = points.groupBy("part").applyInArrow(merged, POINT)
    found = parts.groupBy(F.lit(0).alias("all")).applyInArrow(cut, "place long, x double").collect()  # at most MET * POINTS rows meet
    return np.array([r["x"] for r in sorted(found)], dtype=np.float64)


_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _PRIMES[1]
    x ^= x >> np.uint64(29)
    x *= _PRIMES[2]
    x ^= x >> np.uint64(32)
    return x


def _hashed_int(seeds: np.ndarray, k: int) -> np.ndarray:
    """Spark's xxhash64 of an int after what the seeds (uint64) are hashes of."""
    one, two, three, _, five = _PRIMES
    x = seeds + (five + np.uint64(4))
    x ^= np.uint64(k * int(one) % 2**64)
    return _mixed(_turned(x, 23) * two + three)


def _hashed_long(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The same of longs, such as the microseconds of instants."""
    one, two, _, four, five = _PRIMES
    x = seeds + (five + np.uint64(8))
    x ^= _turned(values * two, 31) * one
    return _mixed(_turned(x, 27) * one + four)


#: Rows whose draws are made together.
DRAWN = 8192


def _intervals(table: np.ndarray, n: int, yhat: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of n draws from the table for each forecast, by the hashes of its row."""
    mean, std = np.empty(len(yhat)), np.empty(len(yhat))
    for at in range(0, len(yhat), DRAWN):
        here = slice(at, at + DRAWN)
        x = np.empty((n, len(yhat[here])))
        for k in range(n):
            place = _hashed_int(seeds[here], k).view(np.int64)
            # The remainder is at least 0, as pmod's; a division by a constant is fast.
            place -= np.floor_divide(place, QUANTILES) * QUANTILES
            np.take(table, place, out=x[k], mode="clip")
        x += yhat[here]
        mean[here] = sum(x, np.zeros(x.shape[1])) / n
        x -= mean[here]
        x *= x
        std[here] = np.sqrt(sum(x, np.zeros(x.shape[1])) / n)
    return mean, std


def predict_intervals(f: DataFrame, residuals: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """Mean and population deviation of n replicas, each the forecast plus a residual drawn by hash.

    ``residuals`` (residual) holds past errors; draws are from QUANTILES of them, a bounded row that goes with
    the plan, so that forecasts are neither copied nor shuffled.
    """
    past = residuals.select(F.col("residual").cast("double").alias("x"))
    table = _quantiles(past.mapInArrow(lambda batches: _read(rows.column(0).drop_null().to_numpy() for rows in batches), POINT))
    if not len(table):
        return f.withColumns({"mean": F.col("yhat"), "std": F.lit(0.0)})

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yhat = rows.column("yhat")
            mean, std = _intervals(table, n, yhat.to_numpy(zero_copy_only=False), rows.column("hash").to_numpy().view(np.uint64))
            none = yhat.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(mean, mask=none), pa.array(std, mask=none)], [*rows.schema.names[:3], "mean", "std"])

    # A row's hash goes on with the number of each draw, as xxhash64 of all of them would.
    chosen = f.select("household_id", "ts", F.col("yhat").cast("double").alias("yhat"), F.xxhash64(F.lit(seed), "household_id", "ts").alias("hash"))
    return chosen.mapInArrow(draw, chosen.drop("hash").schema.add("mean", "double").add("std", "double"))


def persistence_intervals(slots: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """``predict_intervals`` of the previous step's value at all slots of complete series, drawn from their own errors.

    A series is made, compared and drawn from in one task's arrays: once for the errors' quantiles, once for the rows.
    """
    columns, names = ["kwh", "lag_1", "place", "hash"], ["household_id", "ts", "yhat", "mean", "std"]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = (rows.filter(pc.greater(rows.column("place"), 0)) for rows in batches)
        yield from _read(rows.column("kwh").to_numpy() - rows.column("lag_1").to_numpy() for rows in after)

    table = _quantiles(series.complete(slots, columns[:3], only_finite=False, then=(errors, POINT)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rows = rows.filter(pc.greater(rows.column("place"), 0))
            yhat, at = rows.column("lag_1"), rows.column("ts").cast(pa.int64()).to_numpy().view(np.uint64)
            mean, std = _intervals(table, n, yhat.to_numpy(), _hashed_long(rows.column("hash").to_numpy().view(np.uint64), at))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column("ts"), yhat, pa.array(mean), pa.array(std)], names)

    kinds = slots.select("household_id", "ts").schema.add("yhat", "double").add("mean", "double").add("std", "double")
    # Without errors there are no forecasts, either.
    return series.complete(slots, columns, only_finite=False, seed=seed, then=(draw, kinds))


def evaluation_job(f: DataFrame, threshold: float, weight: float = 3.0, lam: float = 0.25) -> DataFrame:
    """One row, of one aggregate: errors, peak events and losses together."""
    return _with_f1(_with_r2(_known(f).agg(*_error_sums(), *_peak_counts(threshold), _blended(threshold, weight, lam))))
