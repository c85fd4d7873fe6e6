"""Learners: clusters of households, local updates, a common teacher."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = ["mean_kwh", "std_kwh", "peak_kwh", "missingness", "zero_fraction"]


def cluster_households(profiles: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Profiles with a ``cluster``: standardised, then K-means; households with a missing figure are skipped."""
    if k <= 1:
        return profiles.dropna(subset=PROFILE).withColumn("cluster", F.lit(0))
    vectors = VectorAssembler(inputCols=PROFILE, outputCol="raw", handleInvalid="skip").transform(profiles)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors).transform(vectors)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(scaled).transform(scaled).drop("raw", "features")


def adaptive_k(profiles: DataFrame, k: int, seed: int = 0, min_size: int = 2) -> DataFrame:
    """Clusters with the largest k up to the given one whose smallest cluster is large enough."""
    while True:
        made = cluster_households(profiles, k, seed)
        least = made.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.min("n"), F.count("*")).first()
        if k <= 1 or (least[0] is not None and least[0] >= min_size and least[1] == k):
            return made
        k -= 1


#: Change of the weights that one batch asks for: (inputs with a column of ones, targets, weights) -> slope.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def smooth_l1_slope(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope of the smooth L1 loss of a linear model, clipped to norm 1."""
    slope = x.T @ np.clip(x @ w - y, -1, 1) / len(y)
    return slope / max(1.0, float(np.linalg.norm(slope)))


def local_updates(sequences: DataFrame, w: np.ndarray, steps: int = 3, rate: float = 0.01, batch: int = 32, seed: int = 0, kernel: Kernel = smooth_l1_slope) -> DataFrame:
    """Per-agent training from the shared weights, by the given kernel.

    sequences: agent_id, seq, x array<double>, y double.  Returns (agent_id, pos, value, n_samples,
    status): the weights' change after mini-batch steps; ``no_data`` agents give one row without a
    value.  Spark draws each step's batch, the rows of least hash, so that a task holds steps * batch rows
    of an agent, however many it has.
    """
    shared = np.asarray(w, dtype=np.float64)
    good = sequences.where((F.size("x") == len(shared) - 1) & F.col("y").isNotNull()).select("agent_id", "seq", "x", "y")
    counts = sequences.groupBy("agent_id").agg(F.count_if((F.size("x") == len(shared) - 1) & F.col("y").isNotNull()).alias("n_samples"))
    draw = F.xxhash64(F.lit(seed), "step", "agent_id", "seq")
    place = F.row_number().over(Window.partitionBy("agent_id", "step").orderBy(draw, "seq"))
    drawn = good.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("place", place).where(F.col("place") <= batch)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        mine = shared.copy()
        for _, part in rows.sort_values(["step", "place"]).groupby("step"):
            x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])
            mine -= rate * kernel(x, part["y"].to_numpy(), mine)
        return pd.DataFrame({"agent_id": rows["agent_id"].iloc[0], "pos": np.arange(len(mine)), "value": mine - shared})

    made = drawn.groupBy("agent_id").applyInPandas(train, "agent_id long, pos int, value double")
    return counts.join(made, "agent_id", "left").select("agent_id", "pos", "value", "n_samples", F.when(F.col("n_samples") > 0, "ok").otherwise("no_data").alias("status"))


def _moments(rows: DataFrame, names: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, means and covariances (divisor n), from one aggregate of plain sums."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    x = [F.col(c).cast("double") for c in names]
    found = rows.agg(F.count("*").cast("double"), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    n = found[0]
    if not n:
        raise ValueError("no rows to learn from")
    mean, square = np.asarray(found[1 : len(x) + 1], dtype=float) / n, np.zeros((len(x), len(x)))
    for (i, j), s in zip(pairs, found[len(x) + 1 :], strict=True):
        square[i, j] = square[j, i] = s / n
    return n, mean, square - np.outer(mean, mean)


def fit_teacher(rows: DataFrame, inputs: list[str], target: str) -> tuple[LinearRegressionModel, DataFrame]:
    """One linear model over all households' feature rows, and their predictions; rows with a missing input are skipped.

    Least squares hangs on the rows only by their number, means and covariances.  So these are summed up over all rows
    in one pass, and the regression is fitted to a few weighted rows that have the same ones; predictions are a sum
    of columns.  No row becomes a vector.
    """
    whole = rows
    for c in inputs:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    label = F.col(target).cast("double")
    sound = F.assert_true(label.isNotNull() & ~F.isnan(label), F.lit("targets must not be null or NaN"))
    n, mean, covariance = _moments(whole.where(sound.isNull()), [*inputs, target])
    if not np.isfinite(covariance).all():
        raise ValueError("features and targets must be finite")
    size, axes = np.linalg.eigh(covariance)
    steps = axes * np.sqrt(np.maximum(size, 0) * len(size))
    few = [(n / (2 * len(size)), *(mean + side * step).tolist()) for step in steps.T for side in (1, -1)]
    same = rows.sparkSession.createDataFrame(few, ", ".join(f"`{c}` double" for c in ("_weight", *inputs, target)))
    vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(same)
    model = LinearRegression(featuresCol="features", labelCol=target, predictionCol="yhat", weightCol="_weight", regParam=1e-3).fit(vectors)
    yhat = F.lit(0.0)
    for c, k in zip(inputs, model.coefficients, strict=True):
        yhat = yhat + F.col(c) * F.lit(float(k))
    return model, whole.withColumn("yhat", yhat + F.lit(float(model.intercept)))
