"""Agents' memories: pooled patterns, attention, shared vectors, episodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def _mean_vector(rows: DataFrame, keys: list[str], name: str = "vector") -> DataFrame:
    """Mean of each place of the groups' arrays; places are keys, so that no group is gathered."""
    places = rows.select(*keys, F.posexplode(name).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda r: r["v"]).alias(name))


def consensus_mean(vectors: DataFrame, key: str = "key") -> DataFrame:
    """Element-wise mean of all agents' vectors of a key."""
    return _mean_vector(vectors, [key])


def pattern_pool(vectors: DataFrame, block: int = 32, capacity: int = 4096, order: str = "ts") -> DataFrame:
    """(agent_id, block, vector): mean of each full block of an agent's vectors, newest blocks only."""
    w = Window.partitionBy("agent_id")
    placed = vectors.withColumns({"i": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)}).withColumn("block", F.floor(F.col("i") / block))
    full = F.floor(F.col("n") / block)
    return _mean_vector(placed.where((F.col("block") < full) & (F.col("block") >= full - capacity)), ["agent_id", "block"])


#: Queries and patterns of one block, where a block of each meets in one task: for the best ones, and for all pairs.
BLOCK, PAIRED = 512, 1024


def _met(queries: DataFrame, pool: DataFrame, on: str, largest: int) -> GroupedData:
    """Queries and patterns (id, vector, asks) of an agent, each group a block of either."""

    def dealt(df: DataFrame, name: str, vector: str, asks: bool, other: str, mine: str) -> DataFrame:
        placed = df.select(on, F.col(name).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.lit(asks).alias("asks")).join(sizes, on)
        block = placed.withColumn(mine, F.pmod(F.xxhash64("id"), F.col(f"{mine}_blocks")).cast("int"))
        return block.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).select(on, "qb", "pb", "id", "vector", "asks")

    count = lambda df, name: df.groupBy(on).agg(F.ceil(F.count("*") / largest).cast("int").alias(name))
    sizes = count(queries, "qb_blocks").join(count(pool, "pb_blocks"), on)
    return dealt(queries, "query_id", "query", True, "pb", "qb").unionByName(dealt(pool, "pattern_id", "key", False, "qb", "pb")).groupBy(on, "qb", "pb")


def _by_width(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width -> (places, matrix) of the vectors without a null."""
    flat, sizes = pc.list_flatten(vectors), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.bincount(owner[flat.is_null().to_numpy()], minlength=len(sizes)) == 0
    values = flat.to_numpy()
    return {int(w): (np.flatnonzero(sizes == w)[whole[sizes == w]], values[(sizes == w)[owner]].reshape(-1, w)[whole[sizes == w]]) for w in np.unique(sizes) if w}


def _logits_of_block(key: tuple, rows: pa.Table) -> pa.Table:
    """The logit of each query of the block with each of its patterns; null where vectors do not fit or hold a null."""
    asks = rows.column("asks")
    q, p = rows.filter(asks), rows.filter(pc.invert(asks))
    logit, known = np.zeros((len(q), len(p))), np.zeros((len(q), len(p)), dtype=bool)
    asked, kept = _by_width(q.column("vector")), _by_width(p.column("vector"))
    for w in asked.keys() & kept.keys():
        (i, x), (j, y) = asked[w], kept[w]
        logit[np.ix_(i, j)], known[np.ix_(i, j)] = x @ y.T / np.sqrt(w), True
    one, other = np.indices(logit.shape).reshape(2, -1)
    return pa.table([pa.repeat(key[0], logit.size), q.column("id").take(pa.array(one)), p.column("id").take(pa.array(other)), pa.array(logit.ravel(), mask=~known.ravel())], names=[rows.column_names[0], "query_id", "pattern_id", "logit"])


def attention_join(queries: DataFrame, pool: DataFrame, on: str = "agent_id") -> DataFrame:
    """(on, query_id, pattern_id, logit): each query beside every pattern of the same agent, with the scaled logit.

    A block of queries and one of patterns meet in one task, as one matrix product: vectors are copied once for each
    block of the other side, not for each pair.
    """
    return _met(queries, pool, on, PAIRED).applyInArrow(_logits_of_block, f"{on} {dict(queries.dtypes)[on]}, query_id long, pattern_id long, logit double")


def _best_of_block(k: int):  # noqa: ANN202
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The k best patterns of the block for each query of the block: by logit, then pattern_id."""
        ids, vectors = rows.column("id"), pc.list_flatten(rows.column("vector")).to_numpy(zero_copy_only=False).astype(float)
        asked = rows.column("asks").to_numpy()
        vectors = vectors.reshape(len(ids), -1) if len(ids) else vectors.reshape(0, 0)
        q, p = vectors[asked], vectors[~asked]
        names, patterns = ids.filter(pa.array(asked)), ids.filter(pa.array(~asked)).to_numpy()
        if not len(q) or not len(p):
            return pa.table([names.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "pattern_id", "logit"])
        scores, scale = q @ p.T, np.sqrt(p.shape[1])
        best = min(k, len(p))
        least = -np.partition(-scores, best - 1, axis=1)[:, best - 1]
        # What could be among the best is summed again in one fixed way, so that equal patterns tie.
        i, j = np.nonzero(scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        logit = (q[i] * p[j]).sum(axis=1) / scale
        order = np.lexsort((patterns[j], -logit, i))
        i, j, logit = i[order], j[order], logit[order]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - first[i] < best
        return pa.table([names.take(pa.array(i[keep])), pa.array(patterns[j[keep]]), pa.array(logit[keep])], names=["query_id", "pattern_id", "logit"])

    return run


def attention_best(queries: DataFrame, pool: DataFrame, k: int = 8, on: str = "agent_id") -> DataFrame:
    """(query_id, pattern_id, logit, place): the k patterns of the same agent with the largest scaled logits.

    Queries and patterns of an agent are dealt to blocks; a block of queries and one of patterns meet
    in one task, which gives the k best of the block for each query.  So rows grow with queries * k * blocks, and
    a query and a pattern are never one row; the best of the blocks are merged by their rank.
    """
    found = _met(queries, pool, on, BLOCK).applyInArrow(_best_of_block(k), "query_id long, pattern_id long, logit double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("logit"), "pattern_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def attention_topk(queries: DataFrame, pool: DataFrame, k: int = 8, on: str = "agent_id") -> DataFrame:
    """(query_id, context): softmax over the k best logits, then the weighted sum of values."""
    w = Window.partitionBy("query_id")
    e = attention_best(queries, pool, k, on).withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    scored = e.withColumn("score", F.col("e") / F.sum("e").over(w)).join(pool.select("pattern_id", "value"), "pattern_id")
    # At most k rows a query.
    one = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.transform("value", lambda v: v.cast("double") * F.col("score")).alias("v")))).alias("rows"))
    total = F.aggregate(F.slice("rows", 2, k), F.col("rows")[0]["v"], lambda s, r: F.zip_with(s, r["v"], lambda a, b: a + b))
    return one.select("query_id", total.alias("context"))


def gated_update(prior: DataFrame, new: DataFrame, lam: float, key: str = "key") -> DataFrame:
    """(1 - lam) M + lam M' per key."""
    m = new.select(key, F.col("vector").alias("fresh"))
    return prior.join(m, key).select(key, F.zip_with("vector", "fresh", lambda a, b: a * (1 - lam) + b * lam).alias("vector"))


def reward(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Minus the absolute error of the forecast; 0 where there was none."""
    return df.withColumn("reward", F.coalesce(-F.abs(F.col(y) - F.col(yhat)), F.lit(0.0)))


def significant_episode(df: DataFrame, min_abs_reward: float = 0.5) -> DataFrame:
    """Episodes with a drift or an action that changes something, and ``journaled`` for large rewards."""
    return df.where(F.col("drift") | ~F.col("action").isin("MAINTAIN", "MONITOR")).withColumn("journaled", F.abs("reward") > min_abs_reward)


def fifo_keep(episodes: DataFrame, capacity: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest episodes of each agent."""
    newest = Window.partitionBy("agent_id").orderBy(*[F.desc(c) for c in order])
    return episodes.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= capacity)
