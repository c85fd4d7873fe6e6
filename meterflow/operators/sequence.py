"""Windows of readings for forecasting: sequences, splits, scaling, horizons, recent rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID = "household_id"
#: Minutes of the forecast stages.
HORIZONS = (15, 30, 45, 60, 120, 180, 1440)


#: Windows of one Arrow batch that leaves a task.
WINDOWS = 512


def _windows(seq_len: int, pred_len: int, n_features: int, step: int):  # noqa: ANN202
    """mapInArrow over sorted runs of (household, ts, features...): a window's rows are cut out of a batch, never collected for each row."""
    span = seq_len + pred_len

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0  # the last rows of the household at hand, and how many came before them
        for batch in them:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                part = rows.slice(a, b - a)
                same = k == 0 and held is not None and held.column(0)[0].as_py() == part.column(0)[0].as_py()
                if same:
                    part = pa.concat_tables([held, part])
                else:
                    place = 0
                yield from _cut(part, place)
                keep = min(span - 1, len(part))
                place += len(part) - keep
                held = part.slice(len(part) - keep)

    def _cut(part: pa.Table, place: int) -> Iterator[pa.RecordBatch]:
        values = np.column_stack([part.column(2 + f).to_numpy().astype(float) for f in range(n_features)])
        known = np.column_stack([part.column(2 + f).is_valid().to_numpy() for f in range(n_features)])
        first = np.arange(max(0, len(part) - span + 1))
        first = first[(first + place) % step == 0]
        for at in range(0, len(first), WINDOWS):
            start = first[at : at + WINDOWS]
            inside = start[:, None] + np.arange(span)[None, :]
            x, x_known = values[inside[:, :seq_len]], known[inside[:, :seq_len]]
            y, y_known = values[inside[:, seq_len:], 0], known[inside[:, seq_len:], 0]
            m = len(start)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(m * seq_len + 1) * n_features, pa.int32()), pa.array(x.reshape(-1), mask=~x_known.reshape(-1)))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * seq_len, pa.int32()), inner)
            last = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * pred_len, pa.int32()), pa.array(y.reshape(-1), mask=~y_known.reshape(-1)))
            column = lambda c, at: part.column(c).take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([column(0, start), column(1, start), column(1, start + span - 1), outer, last], names=[ID, "start_ts", "end_ts", "x", "y"])

    return run


def sequence_windows(df: DataFrame, seq_len: int, pred_len: int, features: list[str], step: int = 1) -> DataFrame:
    """(household, start_ts, end_ts, x, y) for each run of seq_len + pred_len rows of one household; shorter ones give none."""
    rows = df.select(ID, "ts", *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).repartition(ID).sortWithinPartitions(ID, "ts")
    kinds = dict(rows.dtypes)
    schema = f"{ID} {kinds[ID]}, start_ts {kinds['ts']}, end_ts {kinds['ts']}, x array<array<double>>, y array<double>"
    return rows.mapInArrow(_windows(seq_len, pred_len, len(features), step), schema)


def temporal_split(df: DataFrame, cuts: tuple[float, float] = (0.8, 0.9), context: int = 0) -> DataFrame:
    """Rows with each split they serve, by position; val and test start ``context`` rows earlier."""
    w = Window.partitionBy(ID)
    placed = df.withColumns({"i": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count("*").over(w)})
    a, b = (F.col("n") * cuts[0]).cast("int"), (F.col("n") * cuts[1]).cast("int")
    serves = F.filter(
        F.array(
            F.when(F.col("i") < a, "train"),
            F.when((F.col("i") >= a - context) & (F.col("i") < b), "val"),
            F.when(F.col("i") >= b - context, "test"),
        ),
        lambda s: s.isNotNull(),
    )
    return placed.withColumn("split", F.explode(serves)).drop("i", "n")


def last_n_readings(df: DataFrame, n: int = 96) -> DataFrame:
    """The newest n rows of each household, and whether it has as many."""
    w = Window.partitionBy(ID)
    return df.withColumns({"age": F.row_number().over(w.orderBy(F.desc("ts"))), "warm": F.count("*").over(w) >= n}).where(F.col("age") <= n)


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column, 1 where that is 0."""
    std = lambda c: F.stddev_pop(c)
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.when(std(c) == 0, 1.0).otherwise(std(c)).alias(f"{c}_std") for c in columns])


def apply_scaler(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(*df.columns)


def inverse_scale(df: DataFrame, stats: DataFrame, column: str, of: str | None = None) -> DataFrame:
    """Scaled values of a column back in the unit of ``of`` (itself by default)."""
    of = of or column
    return df.crossJoin(F.broadcast(stats)).withColumn(column, F.col(column) * F.col(f"{of}_std") + F.col(f"{of}_mean")).select(*df.columns)


def target_quantile(df: DataFrame, q: float, column: str = "kwh") -> DataFrame:
    return df.agg(F.percentile(column, q).alias("quantile"))


def horizon_table(spark: SparkSession, minutes: int = 15) -> DataFrame:
    """Stages of the curriculum: minutes and steps."""
    return spark.createDataFrame([(i, m, m // minutes) for i, m in enumerate(HORIZONS)], "stage int, minutes int, steps int")


def horizon_targets(df: DataFrame, horizons: DataFrame) -> DataFrame:
    """Each reading with the one so many steps later, for every horizon; none past the end."""
    w = Window.partitionBy(ID).orderBy("ts")
    steps = [(r["stage"], r["minutes"], r["steps"]) for r in horizons.collect()]  # a fixed list of stages
    ahead = df.withColumns({f"y{s}": F.lead("kwh", n).over(w) for s, _, n in steps})
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("minutes"), F.col(f"y{s}").alias("y")) for s, m, _ in steps]))
    return ahead.select(ID, "ts", F.col("kwh").alias("yhat"), each.alias("h")).select(ID, "ts", "yhat", "h.*").where("y is not null")


def baseline_forecast(df: DataFrame, kind: str = "persistence") -> DataFrame:
    """(household, ts, y, yhat): the previous step, or the same slot a week before."""
    steps = {"persistence": 1, "seasonal": 672}[kind]
    return df.select(ID, "ts", F.col("kwh").alias("y"), F.lag("kwh", steps).over(Window.partitionBy(ID).orderBy("ts")).alias("yhat"))


def feature_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in order, as one array."""
    return df.withColumn("features", F.array(*[F.col(c).cast("double") for c in columns]))
