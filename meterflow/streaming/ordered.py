"""Stateful jobs over readings in the order of their time, whatever order they arrive in.

A reading waits in its group's list until the watermark has passed its time; then it is released, in
order of (ts, event_id), to a step whose state is a few numbers or a bounded list.  So the rows are those
of the batch twin, over any number of micro-batches, as long as no reading comes later than the lateness;
those that do are dropped by the watermark (see ``jobs.late_policy`` for keeping them).  What waits is
bounded by the lateness times the rate of a key.  A row without a key only moves the watermark on: a
feed that is quiet, or over, ends with one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterflow.functions.columns import finite
from meterflow.operators.control import drift_scan, sliding_quantile

#: Bounded histories: readings kept per household, and the capacity's week.
RECENT, WEEK, WARM = 96, 672, 96


#: Household ids of a group: a call and a read of state serve so many households at once, however many there are in all.
TOGETHER = 64


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Ordered(StatefulProcessor):
    """Holds rows (key, at in microseconds, event_id, values) back and hands them to ``release`` in order.

    A group's keys share its calls: what waits is a list of Arrow tables, one for each batch, and the cells
    of all its keys are one.
    """

    #: Names of the values that wait beside ``at`` and ``event_id``, and the columns of a key's cell.
    VALUES: tuple[str, ...] = ("kwh",)
    CELL: tuple[tuple[str, pa.DataType], ...] = ()
    #: Name of the column that holds the key; set by ``in_order``.
    key = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.cells = handle.getValueState("cells", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = []
        for df in rows:
            at = df["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            fixed = {"key": pa.array(df[self.key]), "at": pa.array(at), "event_id": pa.array(df["event_id"].to_numpy().astype("int64"))}
            parts.append(pa.table(fixed | {n: pa.array(df[n], from_pandas=True) for n in self.VALUES}))
        new = pa.concat_tables(parts, promote_options="permissive")
        self.waiting.appendValue((_packed(new),))
        self._wake(pc.min(new["at"]).as_py())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = [_unpacked(bytes(r[0])) for r in self.waiting.get()]
        held = pa.concat_tables(chunks, promote_options="permissive") if chunks else None
        past = held is not None and pc.less_equal(held["at"], limit)
        if held is None or not pc.any(past).as_py():
            return
        due, rest = held.filter(past), held.filter(pc.invert(past))
        self.waiting.clear()
        if len(rest):
            self.waiting.appendValue((_packed(rest.combine_chunks()),))
            self._wake(pc.min(rest["at"]).as_py())
        due = due.sort_by([("key", "ascending"), ("at", "ascending"), ("event_id", "ascending")]).combine_chunks()
        keys = due["key"].to_pylist()
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        cells = self._loaded()
        out = self.release(due, [(keys[a], a, b) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)], cells)
        self.cells.update((_packed(pa.table({"key": pa.array(list(cells)), **{n: pa.array([c[i] for c in cells.values()], kind) for i, (n, kind) in enumerate(self.CELL)}})),))
        if len(out):
            yield out

    def _loaded(self) -> dict[Any, tuple]:
        if not self.cells.exists():
            return {}
        known = _unpacked(bytes(self.cells.get()[0]))
        taken = [[v.values.to_numpy(zero_copy_only=False) for v in known[n]] if pa.types.is_list(kind) else known[n].to_pylist() for n, kind in self.CELL]
        return dict(zip(known["key"].to_pylist(), zip(*taken, strict=True), strict=True))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def release(self, due: pa.Table, runs: list[tuple[Any, int, int]], cells: dict[Any, tuple]) -> pd.DataFrame:
        """What the due rows give; each run is a key's, from a place in ``due`` up to another; ``cells`` are changed in place."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _times(at: np.ndarray) -> pd.Series:
    return pd.Series(pd.to_datetime(at, unit="us"))


class Drift(Ordered):
    """The running mean and variance are the state."""

    CELL = (("mean", pa.float64()), ("var", pa.float64()))

    def release(self, due: pa.Table, runs: list[tuple[Any, int, int]], cells: dict[Any, tuple]) -> pd.DataFrame:
        kwh, flags = due["kwh"].to_numpy(), np.zeros(len(due), dtype=bool)
        for key, a, b in runs:
            flags[a:b], mean, var = drift_scan(kwh[a:b], 0.05, 2.0, *cells.get(key, (None, 0.01)))
            cells[key] = (float(mean), float(var))
        return pd.DataFrame({"household_id": due["key"].to_numpy(), "ts": _times(due["at"].to_numpy()), "event_id": due["event_id"].to_numpy(), "kwh": kwh, "drift": flags})


class Recent(Ordered):
    """The newest readings are the state; a row for each release."""

    CELL = (("recent", pa.list_(pa.float64())),)

    def release(self, due: pa.Table, runs: list[tuple[Any, int, int]], cells: dict[Any, tuple]) -> pd.DataFrame:
        kwh, at = due["kwh"].to_numpy(), due["at"].to_numpy()
        for key, a, b in runs:
            cells[key] = (np.concatenate([cells[key][0], kwh[a:b]] if key in cells else [kwh[a:b]])[-RECENT:],)
        kept = [cells[key][0] for key, _, _ in runs]
        return pd.DataFrame({"household_id": [r[0] for r in runs], "ts": _times(at[[b - 1 for _, _, b in runs]]), "recent": kept, "warm": [len(k) >= RECENT for k in kept]})


class Capacity(Ordered):
    """The week's readings that had a forecast are the state."""

    VALUES, CELL = ("kwh", "predicted"), (("recent", pa.list_(pa.float64())),)

    def release(self, due: pa.Table, runs: list[tuple[Any, int, int]], cells: dict[Any, tuple]) -> pd.DataFrame:
        kwh, predicted = due["kwh"].to_numpy(), due["predicted"].cast(pa.float64()).to_numpy()
        some, limits = ~np.isnan(predicted), np.full(len(due), np.nan)
        for key, a, b in runs:
            before, mine = cells[key][0] if key in cells else np.zeros(0), np.flatnonzero(some[a:b]) + a
            found = np.maximum(0.5, sliding_quantile(kwh[mine], before[-(WEEK - 1) :], WEEK, 0.95))
            found[: max(0, WARM - 1 - len(before))] = 1.2
            limits[mine] = found
            cells[key] = (np.concatenate([before, kwh[mine]])[-WEEK:],)
        return pd.DataFrame({"household_id": due["key"].to_numpy(), "ts": _times(due["at"].to_numpy()), "event_id": due["event_id"].to_numpy(), "predicted": predicted, "capacity": limits})


class Patterns(Ordered):
    """The number of the open block, and what has been added up for it, are the state."""

    VALUES, CELL = ("vector",), (("number", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64())))

    def __init__(self, block: int, capacity: int) -> None:
        self.block, self.capacity = block, capacity

    def release(self, due: pa.Table, runs: list[tuple[Any, int, int]], cells: dict[Any, tuple]) -> pd.DataFrame:
        out = []
        for key, a, b in runs:
            number, n, total = cells.get(key, (0, 0, np.zeros(0)))
            for v in due["vector"].slice(a, b - a):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                total, n = (x if n == 0 else total + x), n + 1
                if n == self.block:
                    out.append((key, number, (total / n).tolist(), number - self.capacity if number >= self.capacity else None))
                    number, n, total = number + 1, 0, np.zeros(0)
            cells[key] = (number, n, total)
        return pd.DataFrame(out, columns=["agent_id", "block", "vector", "replaces"]).astype({"replaces": "Int64"})


def complete(df: DataFrame, lateness: str, *needed: str) -> DataFrame:
    """The stream with a watermark on ``ts``, of rows that have a time and all needed columns.

    Rows that lack one are dropped above the watermark, which they move: the condition names ``ts``, so that
    it is not pushed below.
    """
    there = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), 1) for c in ("ts", *needed)]))
    return df.withWatermark("ts", lateness).where(F.size(there) == len(needed) + 1)


def in_order(df: DataFrame, key: str, job: Ordered, lateness: str, schema: str, together: int = 1) -> DataFrame:
    """The job over the rows of each key, a whole number; ``event_id`` orders rows of one time.

    Keys that agree in key // together share a group: their number is bounded, that of the groups grows with theirs.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    clean = df.withColumn("kwh", finite("kwh")) if "kwh" in job.VALUES else df
    rows = complete(clean.select(key, "ts", "event_id", *job.VALUES), lateness, key, job.VALUES[0])
    job.key = key
    grouped = rows.withColumn("_group", F.floor(F.col(key) / together)).groupBy("_group")
    return grouped.transformWithStateInPandas(statefulProcessor=job, outputStructType=schema, outputMode="Append", timeMode="EventTime")
