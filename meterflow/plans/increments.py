"""Features by increments: each run adds what came since the last one, and costs what it adds.

A run leaves, beside its rows, one row of state for each household: its last slot, the sum and number of
observed readings (for imputation) and its last values (for lags and rolling features).  Rows are written once, as
they are made, and each household's last one holds that state, too.  The next run fills
the gap from that slot on, goes on from these numbers, and gives the rows that one run over all
readings would.  Bounds for winsorising come from outside (``bounds``), as a quantile of the whole
series would change rows that are published: from quantile sketches of a training time, say, that grow by
merging (``prepare.quantile_sketches``).

A store holds runs/<id>/rows, runs/<id>/state and runs/<id>/parent, the run that it goes on from; CURRENT
names the last one.  A run that ends half way is not named by anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators import prepare, series
from meterflow.plans.etl import EXTENDED
from meterflow.plans.lineage import settle
from meterflow.sources import readers, writers

ROW = [prepare.HOUSEHOLD, "weather_id", "ts", *EXTENDED]


#: Hourly weather rows that go along with each task; of more, rows are shuffled to them and dealt again.
HOURS = 2**20


def _made(meter: DataFrame, households: DataFrame, weather: DataFrame, bounds: DataFrame, state: DataFrame | None) -> DataFrame:
    """ROW of all new slots in the order of a feature store; the last one of each household has the state after it, too."""
    # Counted, sampled and filled: few rows beside the ones that they fill.
    slots = settle(prepare.resample_15min(prepare.join_metadata(meter, households)))
    if state is not None:
        state = state.select(*_no_state(slots).columns)
    order = (writers.household_bucket(writers.BUCKETS),)
    looks = ["load_missing", *(c for c in EXTENDED if c in series.COLUMNS and c != "load_missing")]
    plain = dict(slots.dtypes)["ts"] == "timestamp_ntz" or slots.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"
    if not plain:
        looks = [c for c in looks if c not in series.CLOCK]
    # Gaps, earlier values and bounds are seen to household by household, and the clock with them; the weather needs only the row.
    grid = series.complete(slots, [*looks, "hour_ts"], bounds, state, ends=True, deal=order).withColumnRenamed("load_missing", "gap")
    hourly = settle(prepare.dedupe_avg(weather, ["weather_id", "ts"], list(prepare.WEATHER)))
    few = hourly.count() <= HOURS
    near = F.broadcast(hourly) if few else hourly
    if plain:
        joined = grid.withColumn("hour_ts", F.col("hour_ts").cast(dict(weather.dtypes)["ts"])).join(near.withColumnRenamed("ts", "hour_ts"), ["weather_id", "hour_ts"], "left")
    else:
        joined = prepare.calendar_features(prepare.weather_hour_join(grid.drop("hour_ts"), near))
    flagged = prepare.missing_flags(prepare.null_nonfinite(joined, list(prepare.WEATHER))).withColumn("load_missing", F.col("gap"))
    made = prepare.fill_defaults(flagged, dict.fromkeys(prepare.WEATHER, 0.0)).select(*ROW, *series.ENDS)
    if few:
        return made
    order += (F.col(prepare.HOUSEHOLD).cast("string"),)
    return made.repartitionByRange(*order).sortWithinPartitions(*order, "ts")


def _ends(made: DataFrame) -> DataFrame:
    """The last row of each household: its state, and what a store's zone map tells of it."""
    return made.where("n_seen is not null").select(*(c for c in made.columns if c == "bucket"), F.col("_metadata.file_path").alias("file"), prepare.HOUSEHOLD, "weather_id", F.col("ts").alias("last_ts"), *series.ENDS)


def _after(ends: DataFrame, state: DataFrame | None) -> DataFrame:
    """The state after the rows: that of their households, and what others had before."""
    last = ends.select(prepare.HOUSEHOLD, "weather_id", "last_ts", "n_seen", "sum_seen", "tail")
    if state is None:
        return last
    return last.unionByName(state.join(last.select(F.col(prepare.HOUSEHOLD).alias("moved")), F.col(prepare.HOUSEHOLD).eqNullSafe(F.col("moved")), "left_anti"))


def increment(meter: DataFrame, households: DataFrame, weather: DataFrame, bounds: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, state) of the readings after each household's last slot; earlier ones are left out.

    Increments are cut at slots: a slot is complete when it comes.  ``weather`` covers the gaps before the
    first new slots, too.  The rows are computed once and settled; both results start from there.
    """
    made = settle(_made(meter, households, weather, bounds, state))
    return made.select(*ROW), _after(_ends(made), state)


def _no_state(slots: DataFrame) -> DataFrame:
    kinds = dict(slots.dtypes)
    return slots.sparkSession.createDataFrame([], f"{prepare.HOUSEHOLD} {kinds[prepare.HOUSEHOLD]}, weather_id {kinds['weather_id']}, last_ts {kinds['ts']}, n_seen bigint, sum_seen double, tail array<double>")


def add_increment(root: str, run_id: str, meter: DataFrame, households: DataFrame, weather: DataFrame, bounds: DataFrame) -> str:
    """Adds the readings that are new to a store and publishes the run; its folder.

    An error if the rows are not finite or the run exists already.
    """
    spark = meter.sparkSession
    parent = writers.current_run(spark, root)
    state = spark.read.parquet(f"{root}/runs/{parent}/state") if parent else None
    target = f"{root}/runs/{writers.checked(run_id)}"
    made = writers.write_ordered(_made(meter, households, weather, bounds, state), f"{target}/rows")
    ends = settle(_ends(made))
    # The weather and the clock are finite as they are made.
    n = ends.agg(F.sum("bad_rows")).first()[0]
    if n:
        writers.remove(spark, f"{target}/rows")
        raise ValueError(f"{n} rows are not finite in {EXTENDED}")
    writers.write_zones(ends.withColumnRenamed("n_rows", "n"), f"{target}/rows")
    _after(ends, state).write.mode("errorifexists").parquet(f"{target}/state")
    writers.write_text(spark, f"{target}/parent", parent or "")
    writers.point(spark, root, run_id)
    return target


def runs(spark: SparkSession, root: str) -> list[str]:
    """The published run and those that it goes on from, the first one first."""
    out, now = [], writers.current_run(spark, root)
    while now:
        out.append(now)
        now = readers.read_text(spark, f"{root}/runs/{now}/parent")
    return out[::-1]


def read_increments(spark: SparkSession, root: str, households: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of all runs of the published state."""
    return reduce(DataFrame.unionByName, [readers.read_features(spark, f"{root}/runs/{r}/rows", households, columns or ROW) for r in runs(spark, root)])
