"""Drift tests, adaptive capacity, load shedding, battery plans and advice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.columns import finite, slot_clock, slot_of_day, tariff_band

ID = "household_id"
#: Sheddable shares of the load, cheapest first, and the names of the actions.
SHARES = (("SHED_EV", 0.3), ("CURTAIL_HVAC", 0.4), ("DIM_LIGHTING", 0.2))


def drift_scan(values: np.ndarray, alpha: float, k: float, mean: float | None = None, var: float = 0.01) -> tuple[np.ndarray, float | None, float]:
    """Flags of one series in order, and the state after it: the test comes before the update."""
    flags = np.zeros(len(values), dtype=bool)
    for i, x in enumerate(values):
        if mean is None:
            mean = float(x)
            continue
        gap = float(x) - mean
        flags[i] = abs(gap) > k * max(0.01, var**0.5)
        mean += alpha * gap
        var = (1 - alpha) * var + alpha * gap * gap
    return flags, mean, var


def drift_flags(df: DataFrame, alpha: float = 0.05, k: float = 2.0) -> DataFrame:
    """Readings with ``drift``: outside k deviations of the running mean; a recursion over each household."""
    schema = df.select(ID, "ts", "event_id", "kwh").schema.add("drift", "boolean")

    def run(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, mean, var = None, None, 0.01
        for batch in them:
            out = []
            for key, rows in batch.groupby(ID, sort=False):
                if key != now:
                    now, mean, var = key, None, 0.01
                flags, mean, var = drift_scan(rows["kwh"].to_numpy(), alpha, k, mean, var)
                out.append(rows.assign(drift=flags))
            if out:
                yield pd.concat(out)

    # Sorted runs rather than whole groups: a household's readings never meet in memory.
    ordered = df.select(ID, "ts", "event_id", "kwh").where(finite("kwh").isNotNull()).repartition(ID).sortWithinPartitions(ID, "ts", "event_id")
    return ordered.mapInPandas(run, schema)


def sliding_quantile(values: np.ndarray, before: np.ndarray, width: int, q: float) -> np.ndarray:
    """Interpolated quantile of each value with up to width - 1 values before it; ``before`` precedes the values."""
    whole = pd.Series(np.concatenate([before, values]), dtype=np.float64)
    return whole.rolling(width, min_periods=1).quantile(q).to_numpy()[len(before) :]


def adaptive_capacity(df: DataFrame, days: int = 7, q: float = 0.95, slots: int = 96, floor: float = 0.5, cold: float = 1.2, forecast: str | None = None) -> DataFrame:
    """The quantile of the last days' readings once there is a day of them, at least the floor; a fixed value before.

    With the name of a forecast column only readings that have a forecast count, as before the first one
    nothing is planned; others have no capacity.  Runs of sorted readings keep one ordered window,
    instead of sorting a window again for each reading; readings without a finite value count as none.
    """
    width = days * slots
    names = [ID, "ts", *[c for c in ("event_id",) if c in df.columns], "kwh", *([forecast] if forecast else [])]
    schema = df.select(*names).schema.add("capacity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = 0, np.zeros(0)
        for batch in batches:
            place, kwh = batch.column("_place").to_numpy(), batch.column("kwh").to_numpy(zero_copy_only=False).astype(np.float64)
            some = np.ones(len(place), dtype=bool)
            if forecast:
                some = ~np.isnan(batch.column(forecast).cast(pa.float64()).to_numpy(zero_copy_only=False))
            limit = np.full(len(place), np.nan)
            starts = np.flatnonzero(place == 1)
            for a, b in zip(np.unique([0, *starts]), [*starts[starts > 0], len(place)], strict=True):
                if place[a : a + 1] == 1:
                    n, last = 0, np.zeros(0)
                mine = np.flatnonzero(some[a:b]) + a
                x = kwh[mine]
                found = np.maximum(floor, sliding_quantile(x, last, width, q))
                found[: max(0, slots - 1 - n)] = cold
                limit[mine] = found
                n, last = n + len(x), np.concatenate([last, x])[-(width - 1) :] if width > 1 else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(limit, from_pandas=True)], names=[*names, "capacity"])

    # Places mark where a household begins; a window takes rows that already lie by household as they are.
    place = F.row_number().over(Window.partitionBy(ID).orderBy(*names[1 : names.index("kwh")]))
    return df.select(*names).where(finite("kwh").isNotNull()).withColumn("_place", place).mapInArrow(run, schema)


def shed_plan(df: DataFrame, predicted: str = "predicted", capacity: str = "capacity") -> DataFrame:
    """Shed amounts and ``actions``: the cheapest loads first, all at once only when they do not suffice.

    Amounts are compared at six places, so that the last bit of a sum decides nothing.
    """
    total = round(sum(share for _, share in SHARES), 9)
    planned = "_need > 0 and round(_need - _all, 6) <= 0"
    out = df.withColumn("_need", F.col(predicted) - F.col(capacity)).withColumn("_all", total * F.col(predicted)).withColumn("_left", F.when(F.expr(planned), F.col("_need")).otherwise(0.0))
    # One projection for each part, so that none is computed again inside the next.
    for name, share in SHARES:
        out = out.withColumn(name.lower(), F.when(F.col("_left") > 0, F.least("_left", share * F.col(predicted))).otherwise(0.0)).withColumn("_left", F.col("_left") - F.col(name.lower()))
    listed = F.array_compact(F.array(*[F.when(F.round(n.lower(), 6) > 0.01, F.lit(n)) for n, _ in SHARES]))
    some = F.lit(False)
    for name, _ in SHARES:
        some = some | (F.round(name.lower(), 6) > 0.01)
    actions = F.when(F.col(predicted).isNull(), F.array(F.lit("MONITOR"))).when(F.round(F.col("_need") - F.greatest("_all", F.lit(0.0)), 6) > 0, F.array(F.lit("CRITICAL_SHED"))).when(some, listed).otherwise(F.array(F.lit("MAINTAIN")))
    return out.withColumn("actions", actions).drop("_need", "_all", "_left")


def federation_ticks(df: DataFrame, every: int = 15, advice: int = 96) -> DataFrame:
    """Ticks counted from 0 per household, with the ones that upload and the ones that advise."""
    tick = F.row_number().over(Window.partitionBy(ID).orderBy("ts")) - 1
    return df.withColumn("tick", tick).withColumns({"uploads": F.col("tick") % every == 0, "advises": (F.col("tick") % advice == 0) & (F.col("tick") > 0)})


def day_slots(df: DataFrame) -> DataFrame:
    """Readings with day and slot of the day."""
    return df.withColumns({"day": F.to_date("ts"), "slot": slot_of_day("ts")})


def peak_and_precool(f: DataFrame, lead: int = 4, keys: tuple[str, ...] = (ID, "day"), value: str = "kwh") -> DataFrame:
    """The first slot of the largest forecast, and when to start cooling before it."""
    peak = F.min(F.struct((-F.col(value)).alias("v"), "slot"))
    return f.groupBy(*keys).agg(peak["slot"].alias("peak_slot")).withColumn("precool_slot", F.greatest(F.lit(0), F.col("peak_slot") - lead))


def plan_cost(plan: DataFrame, keys: tuple[str, ...] = (ID, "day")) -> DataFrame:
    """Cost without and with the battery, and the savings, at the slot's tariff."""
    price = tariff_band("slot")
    base, net = F.sum(price * F.col("kwh")), F.sum(price * (F.col("kwh") - F.col("discharge") + F.col("charge")))
    return plan.groupBy(*keys).agg(base.alias("baseline_cost"), net.alias("scheduled_cost"), (base - net).alias("savings"))


def soc_trajectory(plan: DataFrame, cap: float, eff: float, soc0: float, keys: tuple[str, ...] = (ID, "day"), eps: float = 1e-6) -> DataFrame:
    """State of charge after each slot, whether it stays in bounds, and whether the day ends where it began."""
    w = Window.partitionBy(*keys).orderBy("slot")
    soc = soc0 * cap + F.sum(eff * F.col("charge") - F.col("discharge") / eff).over(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return plan.withColumn("soc", soc).withColumn("in_bounds", F.col("soc").between(-eps, cap + eps)).withColumn("closed", F.abs(F.last("soc").over(whole) - soc0 * cap) <= eps)


#: A convex piecewise linear function: where it starts, its value there, and (slope, length) pieces by slope.
Convex = tuple[float, float, list[tuple[float, float]]]


def _moves(load: float, price: float, rate: float, eff: float, peak_cap: float | None) -> Convex | None:
    """The cost of moving the state of charge by x in a slot, or None if the cap cannot be kept."""
    down = min(rate, load) / eff
    up = rate * eff
    if peak_cap is not None:
        up = min(up, (peak_cap - load) * eff if load <= peak_cap else -(load - peak_cap) / eff)
        if up < -down - 1e-12:
            return None
    up = max(up, -down)
    pieces = [(price * eff, min(up, 0.0) + down), (price / eff, max(up, 0.0))]
    return -down, price * (load - down * eff), [(m, n) for m, n in pieces if n > 0]


def _added(f: Convex, g: Convex) -> Convex:
    """The least f(x) + g(y) over x + y: the pieces of both, by slope, those of f first where they tie."""
    return f[0] + g[0], f[1] + g[1], sorted([*f[2], *g[2]], key=lambda p: p[0])


def _within(f: Convex, low: float, high: float) -> Convex | None:
    """The function between two points."""
    start, value, pieces = f
    out: list[tuple[float, float]] = []
    if start > high + 1e-9:
        return None
    skip = max(0.0, low - start)
    room = high - max(start, low)
    start = max(start, low)
    for m, n in pieces:
        cut = min(skip, n)
        value, skip, n = value + m * cut, skip - cut, n - cut
        n = min(n, room)
        if n > 0:
            out.append((m, n))
            room -= n
    return None if skip > 1e-9 else (start, value, out)


def battery_plan(load: np.ndarray, price: np.ndarray, cap: float, rate: float, eff: float, soc0: float, peak_cap: float | None) -> tuple[str, np.ndarray, np.ndarray]:
    """(status, charge, discharge) of the cheapest plan that ends where it began.

    The least cost of each state of charge after a slot is convex and piecewise linear, so that one more
    slot merges two pieces into those by slope: the plan is exact, without a grid.  It is read backwards: a
    state's share of the slot's pieces is what the battery moved in it.  Of equally cheap plans the one that
    moves late is taken.
    """
    n, none = len(load), np.zeros(len(load))
    if n == 0 or not np.isfinite(load).all() or (load < 0).any():
        return ("empty" if n == 0 else "invalid"), none, none
    begin = soc0 * cap
    states: list[Convex] = [(begin, 0.0, [])]
    moves: list[Convex] = []
    for i in range(n):
        step = _moves(float(load[i]), float(price[i]), rate, eff, peak_cap)
        after = step and _within(_added(states[-1], step), 0.0, cap)
        if not after:
            return "infeasible", none, none
        moves.append(step)
        states.append(after)
    start, _, pieces = states[-1]
    if not start - 1e-9 <= begin <= start + sum(p[1] for p in pieces) + 1e-9:
        return "infeasible", none, none
    moved, now = np.zeros(n), begin
    for i in range(n - 1, -1, -1):
        before, step = states[i], moves[i]
        left, x = now - before[0] - step[0], step[0]
        tagged = sorted([(m, 0, k) for m, k in before[2]] + [(m, 1, k) for m, k in step[2]])
        for _, own, k in tagged:
            take = min(k, max(left, 0.0))
            left -= take
            x += take * own
        moved[i], now = x, now - x
    return "optimal", np.maximum(moved, 0.0) / eff, np.maximum(-moved, 0.0) * eff


def schedule_job(forecasts: DataFrame, capacity: float = 10.0, rate: float = 2.0, eff: float = 0.95, soc0: float = 0.5, peak_cap: float | None = None) -> DataFrame:
    """A battery plan per household and day; a day's slots are one row of arrays, so bounded, and a task plans a batch of days at a time."""
    if capacity <= 0 or rate <= 0 or not 0 <= soc0 <= 1 or not 0 < eff <= 1:
        raise ValueError("capacity and rate must be positive, the first charge in [0, 1], the efficiency in (0, 1]")
    priced = forecasts.select(ID, "day", "slot", F.col("kwh").cast("double").alias("kwh"), tariff_band("slot").alias("price"))
    rows = F.array_sort(F.collect_list(F.struct("slot", "kwh", "price")))
    days = priced.groupBy(ID, "day").agg(rows.alias("rows")).select(ID, "day", *[F.col(f"rows.{c}").alias(c) for c in ("slot", "kwh", "price")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            load, price = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("kwh", "price"))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("kwh")).to_numpy())]).astype(np.int32)
            plans = [battery_plan(load[x:y], price[x:y], capacity, rate, eff, soc0, peak_cap) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            moves = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[k] for p in plans] or [load]))) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p[0] for p in plans], pa.string()), *moves], names=[*batch.schema.names, "status", "charge", "discharge"])

    kinds = dict(days.dtypes)
    planned = days.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in days.columns) + ", status string, charge array<double>, discharge array<double>")
    slots = F.explode(F.arrays_zip("slot", "kwh", "price", "charge", "discharge")).alias("s")
    return planned.select(ID, "day", "status", slots).select(ID, "day", "s.slot", "s.kwh", "s.price", "status", "s.charge", "s.discharge")


def advice_text(df: DataFrame) -> DataFrame:
    """A sentence from peak_slot, precool_slot, charge_slot and discharge_slot; the latter two may be null.

    The wording is a fixed value.
    """
    window = F.coalesce(slot_clock("charge_slot"), F.lit("off-peak"))
    text = F.concat(
        F.lit("Tomorrow's usage is expected to peak around "), slot_clock("peak_slot"),
        F.lit(". Pre-cool your HVAC starting around "), slot_clock("precool_slot"),
        F.lit(". Charge the battery near "), window, F.lit(" and discharge near "), F.coalesce(slot_clock("discharge_slot"), slot_clock("peak_slot")),
        F.lit(". Run your washing machine and other heavy appliances during the "), window, F.lit(" window to save costs."),
    )
    return df.withColumn("advice", text)
