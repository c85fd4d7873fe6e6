"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from meterflow.llm.base import is_hot, settle, spread_join


def _star(edges: DataFrame, small: bool, total: int | None) -> DataFrame:
    """One step: links each node's neighbours to its smallest one; no group is ever gathered.

    ``total`` is given if some node has a large share of the edges, and at least their number; such nodes
    are joined by broadcast.
    """
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = near.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("c")).select("u", F.least("u", "low").alias("low"), "c")
    linked = near.join(lowest.drop("c"), "u") if total is None else spread_join(near, lowest, ["u"], "c", total if small else 2 * total)
    if small:
        out = linked.select(F.col("v").alias("a"), F.col("low").alias("b")).union(lowest.select(F.col("u").alias("a"), F.col("low").alias("b")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> Row:
    """Edges, most edges of a node, and whether a node is linked to another one that is linked itself."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("c"))
    return nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.coalesce(F.max("c"), F.lit(0)).alias("most"), F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("c") > F.col("up"))).alias("tangled")).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    Each round is settled; it ends when every node is linked to the smallest one of its component and
    to no other.  No edges: no rows.
    """
    one, other = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = settle(edges.where(F.col(a) != F.col(b)).select(one, other).distinct())
    while (state := _state(now))["tangled"]:
        total = state["n"] if is_hot(state["most"], state["n"]) else None
        now = settle(_star(_star(now, False, total), True, total))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
