"""Household profiles, balanced cohorts, disjoint splits and assignments.

Selection works by ranks that Spark computes; only sizes per cluster meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.functions.columns import hash_uniform
from meterflow.plans.lineage import settle

ID = "household_id"


def household_profile(df: DataFrame) -> DataFrame:
    """Mean, population deviation, peak, counts, missingness and share of zeros per household."""
    n, nulls, zeros = F.count("*"), F.count_if(F.col("kwh").isNull()), F.count_if(F.col("kwh") == 0)
    return df.groupBy(ID).agg(F.avg("kwh").alias("mean_kwh"), F.stddev_pop("kwh").alias("std_kwh"), F.max("kwh").alias("peak_kwh"), n.alias("n"), nulls.alias("n_null"), zeros.alias("n_zero"), (nulls / n).alias("missingness"), F.try_divide(zeros, n - nulls).alias("zero_fraction"))


def cluster_sizes(assignments: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    sizes = assignments.groupBy("cluster").agg(F.count("*").alias("size"))
    if selected is None:
        return sizes
    taken = selected.groupBy("cluster").agg(F.count("*").alias("selected"))
    return sizes.join(taken, "cluster", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def rank_in_cluster(assignments: DataFrame, seed: int = 0) -> DataFrame:
    """A shuffled rank from 0 inside each cluster, by hash, the same on every run."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string"), F.col(ID).cast("string")), 256)
    return assignments.withColumn("rank_in_cluster", F.row_number().over(Window.partitionBy("cluster").orderBy(key, ID)) - 1)


def balanced_select(assignments: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n households, an equal share of each cluster; what small clusters lack goes round the others, largest first."""
    if n < 1:
        raise ValueError("select at least one household")
    sizes = assignments.groupBy("cluster").agg(F.count("*").alias("size"))
    # One row per cluster, in one task.
    share = sizes.withColumns({"k": F.count("*").over(Window.partitionBy()), "i": F.row_number().over(Window.orderBy("cluster")) - 1})
    share = share.withColumn("share", F.floor(F.lit(n) / F.col("k")) + (F.col("i") < n % F.col("k")).cast("int")).select("cluster", "size", "share")
    ranked = rank_in_cluster(assignments, seed).join(F.broadcast(share), "cluster")
    late = F.col("rank_in_cluster") >= F.col("share")
    turn = F.when(late, F.col("rank_in_cluster") - F.least("share", "size")).otherwise(0)
    return ranked.orderBy(late, turn, -F.col("size"), "cluster", "rank_in_cluster").limit(n).select(ID, "cluster", "rank_in_cluster")


def stratified_split(assignments: DataFrame, train_n: int, val_n: int, test_n: int, seed: int = 0) -> DataFrame:
    """Disjoint val, test and train households; val and test by largest remainder over the clusters."""
    if train_n + val_n + test_n > assignments.count():
        raise ValueError("more households asked for than there are")
    ranked = rank_in_cluster(assignments, seed)
    val = _proportional(ranked, val_n).withColumn("split", F.lit("val"))
    rest = ranked.join(val, ID, "left_anti")
    test = _proportional(rest, test_n).withColumn("split", F.lit("test"))
    rest = rest.join(test, ID, "left_anti")
    train = rest.orderBy("cluster", F.col(ID).cast("string")).limit(train_n).select(ID, "cluster").withColumn("split", F.lit("train"))
    return val.unionByName(test).unionByName(train)


def _proportional(ranked: DataFrame, n: int) -> DataFrame:
    whole = Window.partitionBy()
    sizes = ranked.groupBy("cluster").agg(F.count("*").alias("size"))
    exact = sizes.withColumn("exact", F.lit(float(n)) * F.col("size") / F.sum("size").over(whole))
    low = F.floor("exact")
    sizes = exact.withColumns({"low": low, "part": F.col("exact") - low})
    again = ranked.withColumn("slot", F.row_number().over(Window.partitionBy("cluster").orderBy("rank_in_cluster"))).join(F.broadcast(sizes), "cluster")
    turn = F.greatest(F.col("slot") - F.col("low"), F.lit(0))
    return again.orderBy(turn, F.round(-F.col("part"), 9), -F.col("size"), "cluster", "slot").limit(n).select(ID, "cluster")


def assign_districts(cohort: DataFrame, k: int) -> DataFrame:
    """Districts dealt round robin in order of cluster and rank, so that each mixes the clusters."""
    r = F.row_number().over(Window.orderBy("cluster", "rank_in_cluster")) - 1  # a cohort is a bounded selection
    return cohort.withColumn("district_id", F.concat(F.lit("D"), (r % k + 1).cast("string")))


def alphabetical_cohort(ids: DataFrame, n: int, k: int) -> DataFrame:
    """Without a cohort: the first n households in order of their id as text, dealt to k districts round robin.

    An error if there are fewer.
    """
    name = F.col(ID).cast("string")
    chosen = ids.select(ID).distinct().orderBy(name, ID).limit(n)
    rank = F.row_number().over(Window.orderBy(name, ID)) - 1  # n rows at most
    enough = F.assert_true(F.count("*").over(Window.partitionBy()) == n, F.lit(f"fewer than {n} households"))
    return chosen.select(ID, F.lit(-1).alias("cluster"), rank.alias("rank"), F.concat(F.lit("D"), (rank % k + 1).cast("string")).alias("district_id"), enough.alias("enough")).where("enough is null").drop("enough")


def hash_split(df: DataFrame, key: str, fraction: float, seed: int = 0, prefix: str = "split") -> DataFrame:
    """in_val: the first 8 bytes of SHA-256 of ``prefix:seed:key`` lie under the fraction of 2**64.

    With another program's prefix its splits are met exactly.
    """
    if not 0 <= fraction < 1:
        raise ValueError("the fraction must be in [0, 1)")
    digest = F.sha2(F.concat(F.lit(f"{prefix}:{seed}:"), F.col(key).cast("string")), 256)
    return df.withColumn("in_val", F.substring(digest, 1, 16) < f"{int(fraction * 2**64):016x}")


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with ``place``, counted from 0 in the given order.

    Ranges of rows are sorted by themselves and settled; one count for each of them is all that
    the driver sees.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order, strict=True)})
    ranged = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    held = settle(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(2**33 - 1)}))
    starts, total = [], 0
    for row in held.groupBy("_part").count().orderBy("_part").collect():
        starts += [F.lit(row["_part"]), F.lit(total).cast("long")]
        total += row["count"]
    start = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0).cast("long")
    return held.withColumn("place", start + F.col("_row")).drop("_part", "_row")


def stride_select(ids: DataFrame, k: int, key: str = ID) -> DataFrame:
    """k ids at an even stride of their order as text."""
    placed = numbered(ids.select(key).distinct(), F.col(key).cast("string"))
    n = placed.count()
    return placed.where(F.col("place") % max(1, n // k) == 0).orderBy("place").limit(k).select(key)


def district_sizes(spark: SparkSession, agents: int, k: int) -> DataFrame:
    """An even split of the agents, the remainder going to the first districts."""
    ids = spark.range(1, k + 1).withColumnRenamed("id", "district")
    return ids.select("district", (F.lit(agents // k) + (F.col("district") <= agents % k).cast("int")).alias("size"))


def pick_attackers(agents: DataFrame, fraction: float, seed: int = 0, key: str = "agent_id") -> DataFrame:
    """round(n fraction) agents of the least seeded hash."""
    n = agents.select(key).distinct().count()
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return agents.select(key).distinct().orderBy(order, key).limit(round(n * fraction))


def split_disjointness(split: DataFrame) -> DataFrame:
    """Households that stand in more than one split: none for a sound split."""
    parts = [split.where(F.col("split") == s).select(ID) for s in ("train", "val", "test")]
    return parts[0].intersect(parts[1]).union(parts[0].intersect(parts[2])).union(parts[1].intersect(parts[2]))


def selected_vs_population(everyone: DataFrame, selected: DataFrame) -> DataFrame:
    """Households left out of the cohort."""
    return everyone.select(ID).distinct().join(selected.select(ID), ID, "left_anti")


def train_slot_shards(households: DataFrame, n: int) -> DataFrame:
    """Round-robin shard of each household in order of id."""
    return numbered(households.select(ID).distinct(), F.col(ID).cast("string")).select(ID, (F.col("place") % n).alias("shard"))


def priority_draws(episodes: DataFrame, alpha: float = 0.6, seed: int = 0, key: str = "event_id") -> DataFrame:
    """Episodes with the ``draw`` that ranks them, the least first: exponential at the rate |reward|**alpha + 0.001; null without a reward.

    Without an id there is nothing to hash, and an episode gets the largest draw of its rate.
    """
    weight = F.pow(F.abs("reward"), alpha) + 1e-3
    uniform = F.when(F.col(key).isNotNull(), hash_uniform(key, seed=seed))
    return episodes.withColumn("draw", -F.log(F.greatest(uniform, F.lit(2.0**-49))) / weight)


def least_draws(drawn: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """The n episodes of the least draws, of equal ones those of the least ids; nulls of either come last."""
    return drawn.orderBy(F.asc_nulls_last("draw"), F.asc_nulls_last(key)).limit(n)


def priority_sample(episodes: DataFrame, n: int, alpha: float = 0.6, seed: int = 0, key: str = "event_id") -> DataFrame:
    """n episodes without replacement, the chance of each following |reward|**alpha + 0.001; those without a reward come last."""
    return least_draws(priority_draws(episodes, alpha, seed, key), n, key)
