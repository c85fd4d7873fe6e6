"""Complete series from slots, whole households at a time: what windows over filled rows give, without rows to sort.

Slots are few and filled rows are many: slots are dealt and sorted, and a task fills, imputes, clips and looks back
over arrays of some households.  The rows of a household are held at once, as many as there are slots between its
first and last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.operators.prepare import HOUSEHOLD, filled_parts

WEATHER_ID = "weather_id"

#: Filled rows of the households that are made together; values that the longest lag and window look back on.
TOGETHER, TAIL = 2**16, 96
#: Microseconds of a slot and of an hour.
STEP, HOUR = 900_000_000, 3_600_000_000
#: What comes first for a household: its state, its bounds, then its slots.
STATE, BOUNDS, SLOT = 0, 1, 2
#: Their columns; values of the state go as text, as a null array would be counted again for each row that is sent.
_HEAD = {STATE: {"n_seen": "bigint", "sum_seen": "double", "tail": "string"}, BOUNDS: {"lo": "double", "hi": "double"}}
#: What may be asked for, besides household, weather id and time.
COLUMNS = {"kwh": T.DoubleType(), "load_missing": T.IntegerType(), "place": T.LongType(), "hash": T.LongType()}
COLUMNS |= {c: T.DoubleType() for c in ("lag_1", "lag_4", "lag_96", "roll_mean_4", "roll_std_4", "roll_max_96")}
COLUMNS |= {c: T.DoubleType() for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")} | {"is_weekend": T.IntegerType(), "hour_ts": None}
#: Slots of a day and of a week, which began on a Thursday in 1970.
DAY, WEEK, MONDAY = 96, 672, 3 * 96
#: What the last row of a household holds: the state after it, and the household's first time, rows and rows that are not finite.
ENDS = {"n_seen": T.LongType(), "sum_seen": T.DoubleType(), "tail": T.ArrayType(T.DoubleType()), "first_ts": None, "n_rows": T.LongType(), "bad_rows": T.LongType()}


def complete(slots: DataFrame, columns: list[str], bounds: DataFrame | None = None, state: DataFrame | None = None, ends: bool = False, deal: tuple = (), only_finite: bool = True, seed: int = 0, then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], T.StructType | str] | None = None) -> DataFrame:
    """(household_id, weather_id, ts, columns) of every slot from a household's first one to its last one, by weather id.

    Gaps are filled as by ``gap_fill`` and have the mean of earlier readings as by ``causal_impute``; numbers that are
    not finite count as gaps, too, unless they may stay.  ``bounds`` (household_id, lo, hi) clip as ``clip_bounds`` does; lags, means and maxima
    are those of ``lag_features`` and ``rolling_features``.  With ``state`` (a household's weather_id, last_ts, n_seen,
    sum_seen, tail) slots up to the last one are left out and the series goes on from there.  With ``ends`` the last
    row of each household has ENDS, which are null in the others.  Households are dealt to ranges of their id, or of the
    expressions in ``deal`` and their id as text, and rows leave in that order, by time within a household.  Hours and
    clock features are those of plain time or UTC.  The column ``hash`` is the
    xxhash64 of the seed and the household.  ``then`` (function, schema) takes the rows on in the same task.
    """
    fields = [slots.schema[c] for c in (HOUSEHOLD, WEATHER_ID, "ts")]
    made = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(c, COLUMNS[c] or fields[2].dataType) for c in columns] + [T.StructField(c, k or fields[2].dataType) for c, k in ENDS.items() if ends])
    dealt = _dealt(slots, bounds, state, deal)
    if "hash" in columns:
        dealt = dealt.withColumn("hash", F.xxhash64(F.lit(seed), HOUSEHOLD))
    on, made = then or (lambda rows: rows, made)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _households(batches):
            for part in _parts(whole):
                yield from _filled(part, columns, ends, only_finite)

    return dealt.mapInArrow(lambda batches: on(filled(batches)), made)



def exact_bounds(slots: DataFrame, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """(household_id, lo, hi): quantiles of each household's complete series, the values at these ranks; no row of it leaves a task."""
    kind = T.StructField(HOUSEHOLD, slots.schema[HOUSEHOLD].dataType)
    made = T.StructType([kind, T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _households(batches):
            for part in _parts(whole):
                for rows in _filled(part, ["kwh", "place"], False, True):
                    x, first = rows.column("kwh").to_numpy(), np.flatnonzero(rows.column("place").to_numpy() == 0)
                    found = []
                    for a, b in zip(first, [*first[1:], len(x)], strict=True):
                        at = [max(0, int(np.ceil(q * (b - a))) - 1) for q in (lo, hi)]
                        found.append(np.partition(x[a:b], at)[at])
                    lows, highs = np.array(found).reshape(-1, 2).T
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), pa.array(lows), pa.array(highs)], names=made.names)

    return _dealt(slots, None, None, ()).mapInArrow(run, made)


def _dealt(slots: DataFrame, bounds: DataFrame | None, state: DataFrame | None, deal: tuple) -> DataFrame:
    """Slots, and what households have but once as rows before them, dealt by ranges and sorted."""
    parts = max(int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions")), filled_parts(slots if state is None else slots.select(HOUSEHOLD, WEATHER_ID, "ts").unionByName(state.select(HOUSEHOLD, WEATHER_ID, F.col("last_ts").alias("ts")))))
    rows = slots.select(HOUSEHOLD, WEATHER_ID, "ts", F.col("kwh").cast("double").alias("kwh"), F.lit(SLOT).alias("kind"))
    if state is not None:
        text = F.array_join(F.col("tail").cast("array<string>"), ",")
        head = state.select(HOUSEHOLD, WEATHER_ID, F.col("last_ts").alias("ts"), F.lit(STATE).alias("kind"), "n_seen", "sum_seen", text.alias("tail"))
        rows = rows.unionByName(head, allowMissingColumns=True)
    if bounds is not None:
        # A null household has no bounds, as it is joined with nothing.
        head = bounds.where(F.col(HOUSEHOLD).isNotNull()).select(HOUSEHOLD, F.lit(BOUNDS).alias("kind"), *(F.col(c).cast(k).alias(c) for c, k in _HEAD[BOUNDS].items()))
        rows = rows.unionByName(head, allowMissingColumns=True)
    if not deal:
        return rows.repartitionByRange(parts, HOUSEHOLD).sortWithinPartitions(HOUSEHOLD, "kind", WEATHER_ID, "ts")
    # Computed once for each row, not for each comparison.
    by = [f"_by_{k}" for k in range(len(deal) + 1)]
    placed = rows.withColumns(dict(zip(by, [*deal, F.col(HOUSEHOLD).cast("string")], strict=True)))
    return placed.repartitionByRange(parts, *by).sortWithinPartitions(*by, "kind", WEATHER_ID, "ts").drop(*by)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Places of the column's values among its different ones, a null one too, and these."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _households(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole households, which follow one another."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        code = _codes(rows.column(HOUSEHOLD))[0]
        changes = np.flatnonzero(np.diff(code))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.concat_tables([*held, rows.slice(0, cut)])
            held = [rows.slice(cut)]
        elif held and held[-1].column(HOUSEHOLD)[0].as_py() != rows.column(HOUSEHOLD)[0].as_py():
            yield pa.concat_tables(held)
            held = [rows]
        else:
            held.append(rows)
    if held:
        yield pa.concat_tables(held)


def _parts(rows: pa.Table) -> Iterator[pa.Table]:
    """The rows cut between households into parts that fill to about TOGETHER rows; a larger household alone."""
    code, _ = _codes(rows.column(HOUSEHOLD))
    ts = rows.column("ts").cast(pa.int64()).combine_chunks()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    known = ts.fill_null(pc.max(ts).as_py() or 0).to_numpy()
    spans = (np.maximum.reduceat(known, first) - np.minimum.reduceat(known, first)) // STEP + 1
    ends, size = [*first[1:].tolist(), len(code)], 0
    start = 0
    for k, n in enumerate(spans.tolist()):
        if size and size + n > TOGETHER:
            yield rows.slice(start, int(first[k]) - start)
            start, size = int(first[k]), 0
        size += n
    yield rows.slice(start, ends[-1] - start)


def _back(z: np.ndarray, place: np.ndarray, k: int, other: np.ndarray | float) -> np.ndarray:
    """The value k rows before each in its household; ``other`` where there is none."""
    out = np.empty_like(z)
    out[:k] = other[:k] if isinstance(other, np.ndarray) else other
    np.copyto(out[k:], np.where(place[k:] >= k, z[: max(0, len(z) - k)], other[k:] if isinstance(other, np.ndarray) else other))
    return out


def _looked_back(z: np.ndarray, place: np.ndarray, columns: list[str]) -> dict[str, np.ndarray]:
    out = {c: _back(z, place, int(c[4:]), z) for c in columns if c.startswith("lag_")}
    if "roll_mean_4" in columns or "roll_std_4" in columns:
        n = np.minimum(place + 1, 4)
        last = [_back(z, place, k, 0.0) for k in (3, 2, 1)]
        out["roll_mean_4"] = (((last[0] + last[1]) + last[2]) + z) / n
        # Differences from the row's own value, so that equal values have a deviation of just 0.
        apart = [np.where(place >= k, x - z, 0.0) for k, x in zip((3, 2, 1), last, strict=True)]
        mean = (apart[0] + apart[1] + apart[2]) / n
        squares = mean * mean
        for k, x in zip((3, 2, 1), apart, strict=True):
            squares += np.where(place >= k, (x - mean) ** 2, 0.0)
        out["roll_std_4"] = np.sqrt(squares / n)
    if "roll_max_96" in columns:
        most = z
        for k in (1, 2, 4, 8, 16, 32, 32):
            most = np.maximum(most, _back(most, place, k, most))
        out["roll_max_96"] = most
    return out


def _clock() -> dict[str, np.ndarray]:
    """The calendar features of all slots of a week from Monday on."""
    slot = np.arange(WEEK)
    hour, day = slot % DAY * 24 / DAY * (2 * np.pi / 24), slot // DAY * (2 * np.pi / 7)
    return {"hour_sin": np.sin(hour), "hour_cos": np.cos(hour), "dow_sin": np.sin(day), "dow_cos": np.cos(day), "is_weekend": (slot >= 5 * DAY).astype(np.int32)}


CLOCK = _clock()


def _filled(rows: pa.Table, columns: list[str], ends: bool, only_finite: bool) -> Iterator[pa.RecordBatch]:
    """The complete series of whole households."""
    code, names = _codes(rows.column(HOUSEHOLD))
    weather, stations = _codes(rows.column(WEATHER_ID))
    kind_of_ts = rows.column("ts").type
    ts, kind = rows.column("ts").cast(pa.int64()).fill_null(0).to_numpy(), rows.column("kind").to_numpy()
    numbers = lambda c: rows.column(c).to_numpy()  # noqa: E731  null as NaN
    heads, n = kind == STATE, len(names)
    last_ts, n_seen, sum_seen, tails = np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64), np.zeros(n), {}
    at = np.flatnonzero(heads)
    if len(at):
        last_ts[code[at]] = ts[at]
        n_seen[code[at]], sum_seen[code[at]] = (rows.column(c).take(pa.array(at)).fill_null(0).to_numpy() for c in ("n_seen", "sum_seen"))
        texts = rows.column("tail").take(pa.array(at)).to_pylist()
        tails = {k: np.array(text.split(","), np.float64) for k, text in zip(code[at].tolist(), texts, strict=True) if text}
    fresh = (kind == SLOT) & (ts > last_ts[code])
    goes_on = np.zeros(n, bool)
    goes_on[code[fresh]] = True
    # The last slot before opens the gap to the first new one of its weather id.
    kept = np.flatnonzero(fresh | (heads & goes_on[code]))
    if not len(kept):
        return
    order = kept[np.lexsort((ts[kept], weather[kept], code[kept]))]
    h, w, t, x, opens = code[order], weather[order], ts[order], numbers("kwh")[order], heads[order]
    same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
    count = np.ones(len(order), np.int64)
    count[:-1][same] = np.maximum(1, (t[1:][same] - t[:-1][same]) // STEP)
    count -= opens
    idx = np.repeat(np.arange(len(order)), count)
    gap = np.arange(len(idx)) - np.repeat(np.cumsum(count) - count, count) + opens[idx]
    when, of, station = t[idx] + gap * STEP, h[idx], w[idx]
    read = np.isfinite(x) if only_finite else rows.column("kwh").is_valid().to_numpy()[order]
    seen = (gap == 0) & read[idx]
    value = x[idx]
    if ((h[1:] == h[:-1]) & (w[1:] != w[:-1])).any():
        by = np.lexsort((station, when, of))
        when, of, station, seen, value = when[by], of[by], station[by], seen[by], value[by]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    mine, sizes = of[first], np.diff([*first, len(of)])
    # Sums of what was seen, one reading after the other in each household, each with those of its state before them.
    before = np.cumsum(seen) - seen
    readings, past = value[seen], [*before[first].tolist(), int(seen.sum())]
    sums = [np.cumsum(np.concatenate(([sum_seen[k]], readings[a:b]))) for k, a, b in zip(mine.tolist(), past, past[1:])]  # noqa: B905
    total = np.concatenate(sums)[before + np.repeat(np.arange(len(mine)), sizes)]
    known = before - np.repeat(before[first], sizes) + n_seen[of]
    with np.errstate(over="ignore", invalid="ignore"):
        value = np.where(seen, value, np.where(known > 0, total / np.maximum(known, 1), 0.0))
    bounded = np.flatnonzero(kind == BOUNDS)
    if len(bounded):
        low, high = np.zeros(n), np.full(n, np.nan)
        given = np.zeros(n, bool)
        given[code[bounded]] = rows.column("hi").is_valid().to_numpy()[bounded]
        least = rows.column("lo").is_valid().to_numpy()[bounded]
        low[code[bounded]] = np.where(least, np.maximum(numbers("lo")[bounded], 0.0), 0.0)
        high[code[bounded]] = numbers("hi")[bounded]
        # As in Spark's order of doubles, NaN exceeds all else.
        clips = (given & ((high > low) | (np.isnan(high) & ~np.isnan(low))))[of]
        value = np.where(clips, np.fmin(np.maximum(value, low[of]), high[of]), value)
    # The last values of the state go before those of the household.
    lead = np.array([len(tails.get(k, ())) for k in mine.tolist()] if tails else np.zeros(len(mine)), np.int64)
    base = np.cumsum(lead + sizes) - lead - sizes
    place = np.arange(len(of)) - np.repeat(first - lead, sizes)
    z, spot, row_at = value, place, None
    if lead.any():
        row_at = place + np.repeat(base, sizes)
        z, spot = np.empty(len(of) + int(lead.sum())), np.empty(len(of) + int(lead.sum()), np.int64)
        z[row_at], spot[row_at] = value, place
        for k, b, m in zip(mine.tolist(), base.tolist(), lead.tolist(), strict=True):
            if m:
                z[b : b + m], spot[b : b + m] = tails[k], np.arange(m)
    with np.errstate(over="ignore", invalid="ignore"):
        made = _looked_back(z, spot, columns)
    if row_at is not None:
        made = {c: v[row_at] for c, v in made.items()}
    made |= {"kwh": value, "load_missing": (~seen).astype(np.int32), "place": place}
    if "is_weekend" in columns:
        slot = (when // STEP + MONDAY) % WEEK
        made |= {c: x[slot] for c, x in CLOCK.items()}
    if "hour_ts" in columns:
        made["hour_ts"] = when // HOUR * HOUR
    if "hash" in columns:
        hashed = np.empty(n, np.int64)
        hashed[code] = rows.column("hash").to_numpy()
        made["hash"] = hashed[of]
    arrays = [names.take(pa.array(of)), stations.take(pa.array(station)), pa.array(when).cast(kind_of_ts), *(pa.array(made[c]).cast(kind_of_ts) if c == "hour_ts" else pa.array(made[c]) for c in columns)]
    if ends:
        final = first + sizes - 1
        others = np.ones(len(of), bool)
        others[final] = False
        stop, held = base + lead + sizes, np.minimum(lead + sizes, TAIL)
        offsets = np.zeros(len(of) + 1, np.int32)
        offsets[final + 1] = held
        values = np.concatenate([z[b - m : b] for b, m in zip(stop.tolist(), held.tolist(), strict=True)])
        tail = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(values), mask=pa.array(others))
        bad = ~np.logical_and.reduce([np.isfinite(made[c]) for c in columns])

        def at_end(x: np.ndarray) -> pa.Array:
            out = np.zeros(len(of), x.dtype)
            out[final] = x
            return pa.array(out, mask=others)

        arrays += [at_end(n_seen[mine] + np.diff(past)), at_end(np.array([s[-1] for s in sums])), tail, at_end(when[first]).cast(kind_of_ts), at_end(sizes), at_end(np.add.reduceat(bad.astype(np.int64), first))]
    yield pa.RecordBatch.from_arrays(arrays, names=[HOUSEHOLD, WEATHER_ID, "ts", *columns, *(ENDS if ends else ())])
