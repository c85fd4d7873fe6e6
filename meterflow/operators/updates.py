"""Vector updates of many clients as rows (district_id, agent_id, pos, value), absent is not zero.

A wide model has many positions per agent, and a district many agents; everything here is keyed
by (district, agent) or (district, position), so that no group is larger than one vector or one
coordinate's contributors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from meterflow.functions.columns import finite, hash_uniform

COHORT = ("district_id",)
AGENT = ("district_id", "agent_id")


# --- one update


def flatten_update(updates: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """One array per agent, in order of position."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return updates.groupBy(*keys).agg(F.transform(rows, lambda r: r["value"]).alias("vector"))


def l2_norm(updates: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    return updates.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))


def clip_updates(updates: DataFrame, c: float, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """Values scaled by min(1, c / norm); the original norm is kept in ``l2``."""
    return updates.join(l2_norm(updates, keys), list(keys)).withColumn("value", F.col("value") * clip_factor(c))


def clip_factor(c: float) -> Column:
    """min(1, c / norm), of the norm in ``l2``."""
    if c <= 0:
        raise ValueError("the clipping norm must be positive")
    return F.when(F.col("l2") > c, c / F.col("l2")).otherwise(1.0)


def topk_sparsify(updates: DataFrame, ratio: float, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """All coordinates with ``kept``: true for the max(1, int(n ratio)) largest in size of each update."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    whole = Window.partitionBy(*keys)
    rank = F.row_number().over(whole.orderBy(F.abs("value").desc(), "pos"))
    k = F.greatest(F.lit(1), (F.count("*").over(whole) * ratio).cast("int"))
    return updates.withColumn("kept", rank <= k)


def with_residuals(updates: DataFrame, residuals: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """The updates plus what was held back before."""
    on = [*keys, "pos"]
    both = updates.select(*on, "value").join(residuals.select(*on, F.col("value").alias("rest")), on, "full")
    return both.select(*on, (F.coalesce("value", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))).alias("value"))


def error_feedback(updates: DataFrame, residuals: DataFrame, ratio: float, keys: tuple[str, ...] = AGENT) -> tuple[DataFrame, DataFrame]:
    """(sent, new residuals): last round's residual is added before the largest values are sent."""
    marked = topk_sparsify(with_residuals(updates, residuals, keys), ratio, keys)
    return marked.where("kept").drop("kept"), marked.where("not kept").drop("kept")


def kept_ratio(marked: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """Share of coordinates that are transmitted."""
    return marked.groupBy(*keys).agg(F.avg(F.col("kept").cast("double")).alias("kept_ratio"))


def sparsity(updates: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """Share of coordinates that are exactly zero."""
    return updates.groupBy(*keys).agg(F.avg((F.col("value") == 0).cast("double")).alias("sparsity"))


def gaussian_noise(updates: DataFrame, sigma: float, c: float, seed: int = 0, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """Clips to c and adds N(0, (sigma c)^2) to each value; the noise hangs on ids, so that a retry repeats it."""
    clipped = clip_updates(updates, c, keys).drop("l2")
    if sigma == 0:
        return clipped
    parts = [*keys, "pos"]
    u = F.greatest(hash_uniform(*parts, seed=f"{seed}a"), F.lit(2.0**-49))
    normal = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * hash_uniform(*parts, seed=f"{seed}b"))
    return clipped.withColumn("value", F.col("value") + sigma * c * normal)


def attack_updates(updates: DataFrame, agents: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """Test data: the named agents' values scaled tenfold, flipped, or with unit noise."""
    hit = updates.join(agents.select("agent_id").distinct().withColumn("hit", F.lit(True)), "agent_id", "left")
    if kind == "scale":
        bad = F.col("value") * 10
    elif kind == "flip":
        bad = -F.col("value")
    elif kind == "noise":
        u = F.greatest(hash_uniform("agent_id", "pos", seed=f"{seed}a"), F.lit(2.0**-49))
        bad = F.col("value") + F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * hash_uniform("agent_id", "pos", seed=f"{seed}b"))
    else:
        raise ValueError(f"unknown attack {kind}")
    return hit.withColumn("value", F.when(F.col("hit"), bad).otherwise(F.col("value"))).drop("hit").select(*updates.columns)


def schema_hash(updates: DataFrame, keys: tuple[str, ...] = AGENT, shapes: DataFrame | None = None) -> DataFrame:
    """SHA-256 over an update's sorted positions: equal hashes can be added up.

    ``shapes`` (pos, key, shape, dtype) names the tensor of each position; then the hash is over the
    sorted (key, shape, dtype) of the tensors that are sent.
    """
    if shapes is None:
        what = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")))
        return updates.groupBy(*keys).agg(F.sha2(what, 256).alias("schema_hash"))
    named = updates.join(shapes.select("pos", F.concat("key", "shape", "dtype").alias("tensor")), "pos")
    return named.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_set("tensor"))), 256).alias("schema_hash"))


def validate_updates(updates: DataFrame, coords: DataFrame | None, max_parameters: int, keys: tuple[str, ...] = AGENT, agents: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """(keys, n, reason): null reason for a valid update, else the first rule that it breaks.

    Without ``coords`` all coordinates are known.
    ``agents`` (keys) names who should have sent something: an update without rows is ``empty``.
    ``masks`` (keys, pos) says which coordinates are marked as present: others are a ``mask_mismatch``.
    """
    known = F.lit(True).alias("known")
    joined = updates.select("*", known) if coords is None else updates.join(coords.select("pos").distinct().select("pos", known), "pos", "left")
    n, bad, unknown = F.count("*"), F.count_if(finite("value").isNull()), F.count_if(F.col("known").isNull())
    reason = F.when(n > max_parameters, "too_large").when(bad > 0, "not_finite").when(unknown > 0, "unaligned")
    if masks is not None:
        marked = masks.select(*keys, "pos").distinct().withColumn("marked", F.lit(True))
        sent = joined.withColumn("sent", F.lit(True)).join(marked, [*keys, "pos"], "full")
        n = F.count("sent")
        bad, unknown = F.count_if(F.col("sent") & finite("value").isNull()), F.count_if(F.col("sent") & F.col("known").isNull())
        apart = F.count_if(F.col("sent").isNull() | F.col("marked").isNull())
        reason = F.when(n > max_parameters, "too_large").when(bad > 0, "not_finite").when(unknown > 0, "unaligned").when(apart > 0, "mask_mismatch")
        joined = sent
    out = joined.groupBy(*keys).agg(n.alias("n"), reason.alias("reason"))
    if agents is None:
        return out
    everyone = agents.select(*keys).distinct().join(out, list(keys), "full")
    return everyone.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise(F.col("reason")).alias("reason"))


# --- distances and selection


#: Coordinates of a part, and parts of a span.
PART, SPAN = 256, 16
#: Agents of a block: where pairs are rows, where they are also summed over spans, and where only sums leave a task.
PAIRED, SPANNED, SUMMED = 32768, 512, 16384
#: Agents of the second block whose pairs leave a task together: what is written repeats their ids within a page.
BESIDE = 4096
#: Blocks of at least BLOCK agents that a cohort is dealt to where pairs are rows, so that its pairs are made by some tasks.
BLOCK, SHARES = 64, 4
#: Coordinates whose means one task makes.
STRIP = 16
#: Values of a block, absent ones too; values that are packed at once; pairs that a task holds at once.
CELLS, GATHERED, TILE = 2**23, 2**20, 2**19


def _packs(rows: pa.Table, keys: list[str], out: pa.Schema) -> pa.RecordBatch:
    """Rows of bytes, one for each key: agents with their numbers of values (and scales), coordinates (once, where all have
    the same) and values, of 4 bytes where those say all."""
    code = np.zeros(len(rows), np.int64)
    for k in keys:
        coded = pc.dictionary_encode(rows.column(k).combine_chunks(), null_encoding="encode")
        code = np.unique(code * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)[1]
    named = pc.dictionary_encode(rows.column("agent_id").combine_chunks(), null_encoding="encode")
    agent = named.indices.to_numpy()
    pos, value = rows.column("pos").to_numpy().astype(np.int32), rows.column("value").to_numpy().astype(float)
    order = np.lexsort((pos, agent, code))
    code, agent, pos, value = code[order], agent[order], pos[order], value[order]
    scale = rows.column("scale").to_numpy()[order] if "scale" in out.names else None
    first = np.flatnonzero(np.diff(code, prepend=-1))
    heads, cells = [], {c: [] for c in ("count", "pos", "value", "scale") if c in out.names}
    for at, end in zip(first, [*first[1:], len(code)], strict=True):
        mine, start, count = np.unique(agent[at:end], return_index=True, return_counts=True)
        places, x = pos[at:end], value[at:end]
        once = places[: count[0]]
        places = once if (count == count[0]).all() and (places.reshape(-1, count[0]) == once).all() else places
        with np.errstate(over="ignore"):
            small = x.astype(np.float32)
        heads.append(named.dictionary.take(pa.array(mine)).to_pylist())
        x = small if np.array_equal(small.astype(float), x, equal_nan=True) else x
        for c, v in zip(cells, (count.astype(np.int32), places, x, *([] if scale is None else [scale[at:end][start]])), strict=True):
            cells[c].append(v.tobytes())
    kept, made = rows.take(pa.array(order[first])), cells | {"heads": heads}
    return pa.record_batch([pa.array(made[f.name], f.type) if f.name in made else kept.column(f.name).combine_chunks() for f in out], schema=out)


def _packed(placed: DataFrame, names: list[str]) -> DataFrame:
    """The values of each partition as few rows of bytes (names, blocks, block, span, heads, count, pos, value, scale if there is one), before any shuffle."""
    kinds = dict(placed.dtypes)
    keys, data = [*names, "block", "span"], [c for c in ("count", "pos", "value", "scale") if c != "scale" or c in kinds]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*names, "blocks", "block", "span")), f"heads array<{kinds['agent_id']}>", *(f"{c} binary" for c in data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, out = [], 0, None
        for batch in batches:
            if out is None:
                own = batch.schema
                out = pa.schema([*(own.field(c) for c in (*names, "blocks", "block", "span")), pa.field("heads", pa.list_(own.field("agent_id").type)), *(pa.field(c, pa.binary()) for c in data)])
            held.append(batch)
            n += batch.num_rows
            if n >= GATHERED:
                yield _packs(pa.Table.from_batches(held), keys, out)
                held, n = [], 0
        if n:
            yield _packs(pa.Table.from_batches(held), keys, out)

    return placed.mapInArrow(run, schema)


def _cells(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of values of a packed row's agents, and coordinates and scaled values."""
    count, pos = (np.frombuffer(row[c].as_py(), np.int32) for c in ("count", "pos"))
    value, n = row["value"].as_py(), int(count.sum())
    value = np.frombuffer(value, np.float32 if len(value) == 4 * n else np.float64)
    if "scale" in row:
        value = value * np.repeat(np.frombuffer(row["scale"].as_py(), np.float64), count)
    return count, pos if len(pos) == n else np.tile(pos, n // len(pos)), value


def _dense(lo: int, hi: int, rows: pa.Table) -> tuple[dict[int, pa.Array], dict[int, np.ndarray]]:
    """Agents of a block and of another, and their values over a span of coordinates, 0 where one is absent."""
    block = rows.column("block").to_numpy()
    heads = {b: pc.unique(pc.list_flatten(rows.filter(pa.array(block == b)).column("heads")).combine_chunks()) for b in {lo, hi}}
    cells = {b: [] for b in heads}
    for at in np.flatnonzero(rows.column("value").is_valid().to_numpy()):
        b, row = int(block[at]), {c: rows.column(c)[int(at)] for c in ("heads", "count", "pos", "value", "scale") if c in rows.column_names}
        count, pos, value = _cells(row)
        cells[b].append((np.repeat(np.asarray(pc.index_in(row["heads"].values, heads[b]), dtype=np.int64), count), pos, value))
    places = np.unique(np.concatenate([c[1] for b in cells for c in cells[b]] or [np.zeros(0, np.int32)]))
    dense = {b: np.zeros((len(heads[b]), len(places))) for b in heads}
    for b in cells:
        for agent, pos, value in cells[b]:
            dense[b][agent, np.searchsorted(places, pos)] = value
    return heads, dense


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances of some rows of x to all of y).

    |x|^2 + |y|^2 - 2 x y by one matrix product; pairs that it cannot tell apart well are subtracted.
    """
    of_x, of_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    step = max(1, TILE // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        size = of_x[at : at + step, None] + of_y[None, :]
        d = part @ y.T
        d *= -2
        d += size
        size *= 1e-4
        i, j = np.nonzero(d <= size)
        for k in range(0, len(i), 256):
            p, q = i[k : k + 256], j[k : k + 256]
            d[p, q] = ((part[p] - y[q]) ** 2).sum(axis=1)
        yield at, d


def _block_distances(names: list[str]):  # noqa: ANN202
    beside = BESIDE

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Squared distances between the agents of two blocks (or of one) over a span of coordinates."""
        lo, hi = (int(k.as_py()) for k in key[-3:-1])
        heads, dense = _dense(lo, hi, pa.Table.from_batches(list(batches)))
        for start in range(0, len(dense[hi]), beside):
            for at, d in _tiles(dense[lo], dense[hi][start : start + beside]):
                i, j = np.indices(d.shape).reshape(2, -1)
                i, j, value = i + at, j + start, d.ravel()
                if lo == hi:
                    other = i != j
                    i, j, value = i[other], j[other], value[other]
                one, two = heads[lo].take(pa.array(i)), heads[hi].take(pa.array(j))
                for a, b in [(one, two)] if lo == hi else [(one, two), (two, one)]:
                    yield pa.record_batch([*(pa.repeat(k, len(a)) for k in key[:-3]), a, b, pa.array(value)], names=[*names, "a", "b", "distance"])

    return run


def _block_sums(names: list[str], drop: int):  # noqa: ANN202
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each agent of two blocks (or of one): how many distances to the other's, their sum without the ``drop`` largest, and these."""
        lo, hi = (int(k.as_py()) for k in key[-3:-1])
        heads, dense = _dense(lo, hi, pa.Table.from_batches(list(batches)))
        for b, c in [(lo, lo)] if lo == hi else [(lo, hi), (hi, lo)]:
            m = len(heads[c]) - (b == c)
            top = min(drop, m)
            for at, d in _tiles(dense[b], dense[c]):
                n = len(d)
                if b == c:
                    # The last takes the place of an agent itself.
                    d[np.arange(n), np.arange(at, at + n)] = d[:, m]
                    d = d[:, :m]
                if 0 < top < m:
                    d.partition(m - top, axis=1)
                far = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * top), pa.array(d[:, m - top :].ravel()))
                yield pa.record_batch([*(pa.repeat(k, n) for k in key[:-3]), heads[b].slice(at, n), pa.repeat(pa.scalar(m, pa.int64()), n), pa.array(d[:, : m - top].sum(axis=1)), far], names=[*names, "agent_id", "m", "rest", "far"])

    return run


def _cohorts(updates: DataFrame, names: list[str], chunk: int) -> DataFrame:
    """(keys, sent, width, one): agents with an update of each cohort, from its first coordinate to its last, and whether these lie in one span."""
    pos = F.col("pos").cast("int")
    each = updates.groupBy(*names, "agent_id").agg(F.min(pos).alias("low"), F.max(pos).alias("high"))
    low, high = F.min("low"), F.max("high")
    return each.groupBy(*names).agg(F.count("*").alias("sent"), (high - low + 1).alias("width"), (F.floor(low / (chunk * SPAN)) == F.floor(high / (chunk * SPAN))).alias("one"))


def _typed(updates: DataFrame, names: list[str]) -> DataFrame:
    kinds = {"pos": "int", "value": "double"} | ({"scale": "double"} if "scale" in updates.columns else {})
    return updates.select(*names, *(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def _met(updates: DataFrame, cohorts: DataFrame, names: list[str], chunk: int, largest: int, shares: int, spans: bool = False) -> GroupedData:
    """Blocks of the cohorts in packed parts, each group two blocks (or one) and a span; a block travels once to each of its cohort's blocks."""
    count = F.greatest(F.ceil(F.col("sent") / largest), F.ceil(F.col("sent") * F.least("width", F.lit(chunk * SPAN)) / CELLS), F.least(F.ceil(F.col("sent") / BLOCK), F.lit(shares))).cast("int")
    placed = _typed(updates, [*names, "agent_id"]).join(F.broadcast(cohorts.select(*names, count.alias("blocks"))), names)  # one row for each cohort
    placed = placed.withColumns({"block": F.pmod(F.xxhash64("agent_id"), "blocks").cast("int"), "span": F.floor(F.col("pos") / (chunk * SPAN))})
    rows = _packed(placed, names)
    if spans:
        # All agents of a block go with each of its cohort's spans, as some may have nothing there.
        everyone = placed.groupBy(*names, "blocks", "block").agg(F.collect_set("agent_id").cast(dict(rows.dtypes)["heads"]).alias("heads"))
        rows = rows.unionByName(everyone.join(placed.select(*names, "span").distinct(), names), allowMissingColumns=True)
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*names, F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "span", "block", *(c for c in rows.columns if c in ("heads", "count", "pos", "value", "scale")))
    return met.groupBy(*names, "lo", "hi", "span")


def _schema(updates: DataFrame, names: list[str], *agents: str) -> str:
    kinds = dict(updates.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in names), *(f"{k} {kinds['agent_id']}" for k in agents)])


def _span_sums(updates: DataFrame, cohorts: DataFrame, names: list[str], chunk: int) -> DataFrame:
    """Distances of cohorts of several spans, whose parts are summed up."""
    partial = _met(updates, cohorts, names, chunk, SPANNED, 2 * SHARES, spans=True).applyInArrow(_block_distances(names), f"{_schema(updates, names, 'a', 'b')}, distance double")
    # By the first agent, as the ranking that follows needs it.
    return partial.repartition(*names, "a").groupBy(*names, "a", "b").agg(F.sum("distance").alias("distance"))


def packed_agents(updates: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """Updates as few rows (keys, pos, value) of bytes for each agent; ``unpacked_agents`` gives the rows again."""
    placed = _typed(updates, list(keys)).withColumns({"blocks": F.lit(1), "block": F.lit(0), "span": F.floor(F.col("pos") / PART)})
    return _packed(placed, list(keys)).select(*keys, "pos", "value")


def unpacked_agents(packed: DataFrame) -> DataFrame:
    """(pos, value) of ``packed_agents``, with the other columns there are."""
    kinds = [(c, {"pos": "int", "value": "double"}.get(c, k)) for c, k in packed.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = GATHERED // PART
            for part in (batch.slice(start, step) for start in range(0, batch.num_rows, step)):
                pos = [np.frombuffer(x, np.int32) for x in part.column("pos").to_pylist()]
                value = [np.frombuffer(x, np.float32 if len(x) == 4 * len(p) else np.float64) for x, p in zip(part.column("value").to_pylist(), pos, strict=True)]
                at = pa.array(np.repeat(np.arange(len(pos)), [len(p) for p in pos]))
                made = {"pos": pa.array(np.concatenate(pos)), "value": pa.array(np.concatenate(value).astype(float))}
                yield pa.record_batch([made[c] if c in made else part.column(c).take(at) for c, _ in kinds], names=[c for c, _ in kinds])

    return packed.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds))


def pairwise_distance(updates: DataFrame, keys: tuple[str, ...] = COHORT, chunk: int = PART) -> DataFrame:
    """(keys, a, b, distance): squared distance of each ordered pair of agents of a cohort; absent is 0 here.

    A column ``scale`` of the updates, where there is one, is a factor of all values of an agent.
    Agents are dealt to blocks.  Where it is read, a partition packs its values of a block to rows of bytes, and
    these travel to each block of the cohort; two blocks meet over a span of ``SPAN`` times ``chunk`` coordinates.
    Where a cohort's coordinates lie in one span, its pairs leave that task, some at a time, and are shuffled no
    more; of a wide model sums of spans leave the tasks and are added up, so that no two vectors become a row.
    """
    names = list(keys)
    cohorts = _cohorts(updates, names, chunk)
    pairs = _met(updates, cohorts.where("one"), names, chunk, PAIRED, SHARES).applyInArrow(_block_distances(names), f"{_schema(updates, names, 'a', 'b')}, distance double")
    return pairs.unionByName(_span_sums(updates, cohorts.where("not one"), names, chunk))


def krum_scores(updates: DataFrame, f: int, keys: tuple[str, ...] = COHORT, agents: DataFrame | None = None, chunk: int = PART) -> DataFrame:
    """(keys, agent_id, score): what ``krum_score`` makes of the pairwise distances, without the pairs as rows.

    The n - f - 2 least distances are all but the f + 1 largest: for each agent a task of two blocks gives the sum
    of the others' distances without the f + 1 largest, and these, from which those of all blocks are cut.  Cohorts
    of several spans take the pairs.  ``agents`` (keys, agent_id), where given, holds all agents with updates;
    ``scale`` is as in ``pairwise_distance``.
    """
    if f < 0:
        raise ValueError("f must not be negative")
    names = list(keys)
    cohorts = _cohorts(updates, names, chunk)
    everyone = (updates if agents is None else agents).select(*names, "agent_id").distinct().join(cohorts.select(*names, "one"), names, "left")
    wide = krum_score(_span_sums(updates, cohorts.where("not one"), names, chunk), f, keys, everyone.where("not one").drop("one"))
    sums = _met(updates, cohorts.where("one"), names, chunk, SUMMED, 1).applyInArrow(_block_sums(names, f + 1), f"{_schema(updates, names, 'agent_id')}, m bigint, rest double, far array<double>")
    merged = sums.groupBy(*names, "agent_id").agg(F.sum("m").alias("m"), F.sum("rest").alias("rest"), F.array_sort(F.flatten(F.collect_list("far"))).alias("far"))
    sized = everyone.where("one is null or one").withColumn("n", F.count("*").over(Window.partitionBy(*names))).drop("one")
    sound = (F.lit(f == 0) | (F.col("n") >= 2 * f + 3)) & (F.coalesce("m", F.lit(0)) < F.col("n"))
    need = F.assert_true(sound, F.lit("a cohort needs at least 2f + 3 agents, and all that have updates"))
    cut = F.greatest(F.lit(0), F.least(F.size("far"), F.col("m") - (F.col("n") - f - 2)).cast("int"))
    near = F.aggregate(F.slice("far", F.lit(1), F.size("far") - cut), F.col("rest"), lambda s, x: s + x)
    scored = sized.join(merged, [*names, "agent_id"], "left").where(need.isNull()).select(*names, "agent_id", F.coalesce(near, F.lit(0.0)).alias("score"))
    return scored.unionByName(wide)


def krum_score(distances: DataFrame, f: int, keys: tuple[str, ...] = COHORT, agents: DataFrame | None = None) -> DataFrame:
    """(keys, agent_id, score): sum of an agent's n - f - 2 least distances; f > 0 needs n >= 2 f + 3.

    ``agents`` (keys, agent_id) names the cohorts, so that an agent without any pair is scored too:
    0 for f = 0.  Without it the cohorts are those of the pairs.
    """
    if f < 0:
        raise ValueError("f must not be negative")
    if agents is None:
        agents = distances.select(*keys, F.col("a").alias("agent_id"))
    whole = Window.partitionBy(*keys)
    sized = agents.select(*keys, "agent_id").distinct().withColumn("n", F.count("*").over(whole))
    ranked = distances.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("distance", "b")))
    joined = sized.join(ranked.withColumnRenamed("a", "agent_id"), [*keys, "agent_id"], "left")
    need = F.assert_true(F.lit(f == 0) | (F.col("n") >= 2 * f + 3), F.lit("a cohort needs at least 2f + 3 agents"))
    near = F.sum(F.when(F.col("r") <= F.col("n") - f - 2, F.col("distance")))
    return joined.where(need.isNull()).groupBy(*keys, "agent_id").agg(F.coalesce(near, F.lit(0.0)).alias("score"))


def multi_krum(scores: DataFrame, f: int, k: int | None = None, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """Scores with rank and ``accepted``: the n - f (or k) lowest; all of them for f = 0."""
    whole = Window.partitionBy(*keys)
    rank = F.row_number().over(whole.orderBy("score", "agent_id"))
    limit = F.count("*").over(whole) - f if k is None else F.lit(k)
    return scores.withColumn("rank", rank).withColumn("accepted", F.lit(f == 0) | (rank <= limit))


def krum_select(scores: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """The agent of the least score of each cohort."""
    return scores.groupBy(*keys).agg(F.min(F.struct("score", "agent_id")).alias("best")).select(*keys, F.col("best.agent_id").alias("agent_id"), F.col("best.score").alias("score"))


# --- means


def weighted_mean_update(updates: DataFrame, weights: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """Per coordinate sum of value and weight over the cohort's whole weight: an absent value counts as zero."""
    total = weights.groupBy(*keys).agg(F.sum("n_samples").alias("total"))
    summed = updates.join(weights, [*keys, "agent_id"]).groupBy(*keys, "pos").agg(F.sum(F.col("value") * F.col("n_samples")).alias("s"))
    return summed.join(total, list(keys)).where("total > 0").select(*keys, "pos", (F.col("s") / F.col("total")).alias("value"))


def masked_weighted_mean(updates: DataFrame, weights: DataFrame, coords: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """Per coordinate mean over those who sent it; 0 and not contributed where no one did."""
    w = updates.join(weights, [*keys, "agent_id"]).groupBy(*keys, "pos").agg((F.sum(F.col("value") * F.col("n_samples")) / F.sum("n_samples")).alias("value"))
    return over_coords(w, weights, coords, keys)


def over_coords(means: DataFrame, cohort: DataFrame, coords: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The means at all coordinates (pos) of each cohort, or at its own (keys, pos)."""
    own = [k for k in keys if k in coords.columns]
    known = coords.select(*own, "pos").distinct()
    cohorts = cohort.select(*keys).distinct()
    everywhere = cohorts.join(known, own) if own else cohorts.join(known)
    out = everywhere.join(means, [*keys, "pos"], "left")
    return out.select(*keys, "pos", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("contributed"))


def trimmed_mean(updates: DataFrame, r: float, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """Per coordinate mean without int(r n) values at either end; the plain mean if nothing were left."""
    if not 0 <= r < 0.5:
        raise ValueError("the ratio must be in [0, 0.5)")
    whole = Window.partitionBy(*keys, "pos")
    ranked = updates.withColumns({"i": F.row_number().over(whole.orderBy("value", "agent_id")), "n": F.count("*").over(whole)}).withColumn("cut", (F.col("n") * r).cast("int"))
    return ranked.where("i > cut and i <= n - cut").groupBy(*keys, "pos").agg(F.avg("value").alias("value"))


def packed_trimmed_mean(updates: DataFrame, r: float, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """``trimmed_mean`` of finite values, times ``scale`` where there is one, that travel in packed parts: a task holds STRIP coordinates' contributors."""
    if not 0 <= r < 0.5:
        raise ValueError("the ratio must be in [0, 0.5)")
    names = list(keys)
    kinds = dict(updates.dtypes)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cells = [_cells({c: rows.column(c)[at] for c in rows.column_names}) for at in range(len(rows))]
        pos, value = (np.concatenate([c[i] for c in cells]) for i in (1, 2))
        order = np.lexsort((value, pos))
        places, start, count = np.unique(pos[order], return_index=True, return_counts=True)
        cut = (count * r).astype(int)
        means = [value[order[s + c : s + n - c]].mean() for s, n, c in zip(start, count, cut, strict=True)]
        return pa.table([*(pa.repeat(k, len(places)) for k in key[:-1]), pa.array(places), pa.array(means)], names=[*names, "pos", "value"])

    placed = _typed(updates, [*names, "agent_id"]).withColumns({"blocks": F.lit(1), "block": F.lit(0), "span": F.floor(F.col("pos") / STRIP)})
    packed = _packed(placed, names).drop("blocks", "block", "heads")
    return packed.groupBy(*names, "span").applyInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "pos int", "value double"]))


def masked_trimmed_mean(updates: DataFrame, r: float, coords: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """The trimmed mean over present values only, with ``contributed`` for every coordinate."""
    return over_coords(trimmed_mean(updates, r, keys), updates, coords, keys)


# --- global state


def apply_global_delta(w: DataFrame, delta: DataFrame) -> DataFrame:
    """W + delta where a coordinate was contributed."""
    d = delta.select("pos", F.col("value").alias("d"), "contributed")
    return w.join(d, "pos", "left").select("pos", (F.col("value") + F.when(F.col("contributed"), F.col("d")).otherwise(0.0)).alias("value"))


def relative_update_gate(w: DataFrame, delta: DataFrame, limit: float = 0.25) -> DataFrame:
    """One row: both norms, their ratio, and whether the update may be applied."""
    a = w.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm_w"))
    b = delta.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm_delta"))
    ratio = F.try_divide("norm_delta", "norm_w")
    return a.crossJoin(b).withColumn("ratio", ratio).withColumn("accepted", ~F.coalesce(ratio > limit, F.lit(False)))


def state_drift(prev: DataFrame, curr: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Norm of the difference over shared coordinates."""
    old = prev.withColumnRenamed("value", "old")
    both = curr.join(old, [*keys, "pos"])
    return both.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("old"), 2))).alias("drift"))


def converged_rounds(drift: DataFrame, eps: float, patience: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rounds with ``stable_rounds``, the run of rounds under eps so far, and ``converged``."""
    order = Window.partitionBy(*keys).orderBy("round_id")
    broken = drift.withColumn("run", F.sum(F.when(F.coalesce(F.col("drift") < eps, F.lit(False)), 0).otherwise(1)).over(order))
    stable = F.sum(F.when(F.col("drift") < eps, 1).otherwise(0)).over(Window.partitionBy(*keys, "run").orderBy("round_id"))
    return broken.withColumn("stable_rounds", stable).withColumn("converged", F.col("stable_rounds") >= patience).drop("run")


def shape_overlay(target: DataFrame, source: DataFrame, key: str = "key") -> DataFrame:
    """Values of the source where it has the key in the same size, else the target's."""
    sizes = lambda df: df.groupBy(key).agg(F.count("*").alias("size"))
    fits = sizes(target).join(sizes(source), [key, "size"]).select(key)
    taken = source.join(fits, key).select(key, "pos", F.col("value").alias("taken"))
    return target.join(taken, [key, "pos"], "left").withColumn("value", F.coalesce("taken", "value")).drop("taken")


# --- rounds


def metrics_join(manifest: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """The manifest with each agent's metrics, 0 where there are none."""
    joined = manifest.join(metrics.select("agent_id", *columns), "agent_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def stale_upload_reject(uploads: DataFrame, rounds: DataFrame) -> DataFrame:
    """Uploads with status: accepted in the district's round, stale before it, future after it."""
    now = rounds.select("district_id", F.col("round_id").alias("current"))
    status = F.when(F.col("current").isNull(), "unknown").when(F.col("round_id") == F.col("current"), "accepted").when(F.col("round_id") < F.col("current"), "stale").otherwise("future")
    return uploads.join(now, "district_id", "left").withColumn("status", status).drop("current")


def missing_pairs(expected: DataFrame, got: DataFrame, keys: tuple[str, ...] = AGENT) -> DataFrame:
    """Expected keys that did not report."""
    return expected.select(*keys).distinct().join(got.select(*keys).distinct(), list(keys), "left_anti")


def upsert_uploads(uploads: DataFrame, keys: tuple[str, ...] = ("round_id", "agent_id"), order: str = "seq") -> DataFrame:
    """The last write of each key."""
    rest = [c for c in uploads.columns if c not in keys]
    return uploads.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def usable_cohort(manifest: DataFrame, store: DataFrame, need: int) -> DataFrame:
    """The manifest's households that are in the store; an error if they are fewer than needed."""
    usable = manifest.join(store.select("household_id").distinct(), "household_id", "left_semi")
    n = usable.select("household_id").distinct().count()
    if n < need:
        raise ValueError(f"{n} usable households, {need} requested")
    return usable


def cohort_score_stats(scores: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.count_if(F.col("accepted")).alias("n_accepted"), F.count("*").alias("n_total"))


def round_metrics(agents: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """Acceptance, and mean and sample deviation of the last loss (0 for one agent)."""
    n, ok = F.count("*"), F.count_if(F.col("accepted"))
    return agents.groupBy(*keys).agg(ok.alias("n_accepted"), n.alias("n_total"), (ok / n).alias("acceptance_rate"), F.avg("loss").alias("loss_mean"), F.coalesce(F.stddev_samp("loss"), F.lit(0.0)).alias("loss_std"))
