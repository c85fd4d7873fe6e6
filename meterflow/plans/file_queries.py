"""Sources and sinks as registered queries: whole tables go through files of the shared folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators import prepare, report, series, updates
from meterflow.plans import etl, increments
from meterflow.plans import views as v
from meterflow.plans.lineage import settle, shared_folder
from meterflow.plans.queries import _COHORT, _SQL, _audit, _picked, _r, query
from meterflow.sources import readers, writers

_AUDIT_SCHEMA = "agent_id bigint, accepted boolean, n_samples bigint, krum_score double, original_l2 double, clipped_l2 double, district_id string, round_id string"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame, names: dict[str, str], folder: str) -> str:
    """Columns under the raw files' names, separated by semicolons."""
    back = {ours: theirs for theirs, ours in names.items()}
    text = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c, t in df.dtypes if t.startswith("timestamp")}
    df.select(*[text.get(c, F.col(c)).alias(back[c]) for c in df.columns]).write.options(header=True, sep=";").csv(folder)
    return folder


@query(f"select household_id::varchar as household_id, ts, {_r('kwh', 'kwh')} from meter")
def scan_meter_csv(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_meter(spark, _as_csv(v.meter(spark, d), readers.METER, _folder(spark)))


@query("select household_id::varchar as household_id, weather_id from households")
def scan_households(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_households(spark, _as_csv(v.households(spark, d), readers.HOUSEHOLDS, _folder(spark)))


@query(f"select weather_id, ts, {_r('temperature', 'temperature')}, {_r('humidity', 'humidity')}, {_r('sunshine', 'sunshine')} from weather")
def scan_weather(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_weather(spark, _as_csv(v.weather(spark, d), readers.WEATHER, _folder(spark)))


def _stored(spark: SparkSession, d: str) -> str:
    """The observed slots of all households, published as a version."""
    root = _folder(spark)
    rows = v.slots(spark, d).where("weather_id is not null").withColumn("household_id", F.col("household_id").cast("string"))
    writers.publish_version(rows, root, "first", ("weather_id",))
    writers.publish_version(rows, root, "second", ("weather_id",))
    return writers.resolve_current(spark, root)


_STORED = f"select household_id::varchar as household_id, weather_id, ts, {_r('kwh', 'kwh')} from slots where weather_id is not null"


@query(_STORED)
def publish_version(spark: SparkSession, d: str) -> DataFrame:
    path = _stored(spark, d)
    if not path.endswith("/runs/second"):
        raise ValueError(f"the last version is not the current one: {path}")
    return readers.read_features(spark, path)


@query(f"select * from ({_STORED}) where household_id in ('1', '2', '3')")
def read_features(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_features(spark, _stored(spark, d), ["1", "2", "3"], ["household_id", "weather_id", "ts", "kwh"])


@query(_STORED)
def write_features(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.write_features(v.slots(spark, d).where("weather_id is not null").withColumn("household_id", F.col("household_id").cast("string")), path)
    return readers.read_features(spark, path)


@query(f"select * from ({_STORED}) where household_id in ('1', '2', '3')")
def read_zones(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.write_features(v.slots(spark, d).where("weather_id is not null").withColumn("household_id", F.col("household_id").cast("string")), path)
    return readers.read_features(spark, path, ["1", "2", "3"], ["household_id", "weather_id", "ts", "kwh"])


@query()
def etl_increments(spark: SparkSession, d: str) -> DataFrame:
    """The readings in three runs, one after the other."""
    root, meter = _folder(spark), v.meter(spark, d)
    low, high = meter.agg(F.min("ts"), F.max("ts")).first()
    bounds, households, weather = settle(series.exact_bounds(settle(v.slots(spark, d)))), settle(v.households(spark, d)), settle(v.weather(spark, d))
    third = (high - low) / 3
    cuts = [(low + k * third).replace(minute=0, second=0, microsecond=0) for k in (1, 2)]
    for k, (a, b) in enumerate(zip([low, *cuts], [*cuts, high + third], strict=True)):
        part = meter.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
        increments.add_increment(root, f"run-{k}", part, households, weather, bounds)
    return increments.read_increments(spark, root)


_SQL["etl_increments"] = _SQL["etl_job"]


@query("select household_id, true as lo_near, true as hi_near from imputed group by 1")
def winsor_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of two halves, merged: the ranks of their quantiles in the whole series are near the ones asked for."""
    rows = v.imputed(spark, d).where("kwh is not null")
    halves = prepare.quantile_sketches(rows.withColumn("half", F.pmod(F.xxhash64("ts"), F.lit(2))), by=("half",))
    bounds = prepare.sketch_bounds(prepare.merge_sketches(halves))
    ranked = rows.join(bounds, "household_id").groupBy("household_id").agg(*[x.alias(n) for k in ("lo", "hi") for n, x in ((f"{k}_below", F.avg((F.col("kwh") < F.col(k)).cast("double"))), (f"{k}_to", F.avg((F.col("kwh") <= F.col(k)).cast("double"))))])
    near = lambda k, q: (F.col(f"{k}_below") <= q + 0.002) & (F.col(f"{k}_to") >= q - 0.002)
    return ranked.select("household_id", near("lo", 0.001).alias("lo_near"), near("hi", 0.999).alias("hi_near"))


@query("select distinct weather_id from slots where weather_id is not null")
def discover_partitions(spark: SparkSession, d: str) -> DataFrame:
    return readers.discover_partitions(spark, _stored(spark, d), "weather_id")


@query("select count(distinct weather_id) as n_files, true as has_bytes from slots where weather_id is not null")
def layout_stats(spark: SparkSession, d: str) -> DataFrame:
    return readers.layout_stats(spark, _stored(spark, d)).select("n_files", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("select household_id::varchar as household_id, cluster::int as cluster, rank_in_cluster::int as rank_in_cluster from picked", more=_COHORT)
def read_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.write_manifest(_picked(spark, d), path, {"source": "events"})
    return readers.read_manifest(spark, path)


@query(None)
def append_audit(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark), settle(_audit(spark, d))
    for k in (0, 1):
        writers.append_audit(rows.where(F.col("agent_id") % 2 == k), path)
    return readers.read_audit(spark, path, _AUDIT_SCHEMA).select("agent_id", "accepted", "n_samples", "krum_score", "original_l2", "clipped_l2", F.col("district_id").cast("long").alias("district_id"), F.col("round_id").cast("long").alias("round_id"))


_AUDIT_ROWS = {"audit": "select k.district_id, agent_id % 4 as round_id, k.agent_id, accepted, n_samples, score as krum_score, l2 as original_l2, least(l2, 7.5) as clipped_l2 from krum k join norms using (district_id, agent_id) join client_meta using (district_id, agent_id)"}
_SQL["append_audit"] = v.with_views(f"select agent_id, accepted, n_samples, {_r('krum_score', 'krum_score')}, {_r('original_l2', 'original_l2')}, {_r('clipped_l2', 'clipped_l2')}, district_id, round_id from audit", _AUDIT_ROWS)


@query(f"select pos, {_r('value', 'value')} from global_w")
def checkpoint_round(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.checkpoint_round(v.global_w(spark, d), path, 4)
    return readers_round(spark, path)


def readers_round(spark: SparkSession, path: str) -> DataFrame:
    return writers.resume_round(spark, path, 5).select(F.col("pos").cast("long").alias("pos"), "value")


@query(f"select event_id, {_r('value', 'value')} from events")
def finite_gate(spark: SparkSession, d: str) -> DataFrame:
    e = prepare.require_columns(v.table(spark, d, "events"), ["event_id", "value"], "events")
    return prepare.finite_gate(e.select("event_id", "value"), ["value"])


_DQ = [("n_files", "(select count(distinct weather_id) from slots where weather_id is not null)"), ("grid_rows", "count(*)"), ("grid_households", "count(distinct household_id)"), ("grid_null_kwh", "count(*) filter (kwh is null)"), ("null_ratio", "round(count(*) filter (kwh is null) / greatest(count(*), 1), 6)")]


@query("select " + ", ".join(f"{sql} as {name}" for name, sql in _DQ) + ", true as same_table from grid")
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    """The report's JSON, and whether its Markdown has the same measures and values."""
    counts = settle(prepare.dq_counts({"grid": v.grid(spark, d)}))
    ratios = counts.select(F.round(F.col("grid_null_kwh") / F.greatest("grid_rows", F.lit(1)), 6).alias("null_ratio"))
    layout = readers.layout_stats(spark, _stored(spark, d)).select("n_files")
    text = report.dq_report(counts, ratios, layout)
    kept = spark.createDataFrame([(text["json"],)], "j string").select(F.from_json("j", "grid_rows long, grid_households long, grid_null_kwh long, null_ratio double, n_files long").alias("r")).select("r.*")
    cells = {m: x for m, x in (line.strip("| ").split(" | ") for line in text["markdown"].splitlines()[2:])}
    first = kept.first().asDict()
    return kept.withColumn("same_table", F.lit(cells == {k: str(x) for k, x in first.items()}))


@query("select district_id, agent_id, n, case when agent_id % 6 = 5 then 'empty' when agent_id % 6 = 1 then 'mask_mismatch' end as reason from (select district_id, agent_id, case when agent_id % 6 = 5 then 0 else c end as n from (select district_id, agent_id, count(*) as c from updates group by 1, 2))")
def validate_masked_updates(spark: SparkSession, d: str) -> DataFrame:
    u = v.updates(spark, d)
    masks = u.where("agent_id % 6 <> 5 and not (agent_id % 6 = 1 and pos = 3)").select("district_id", "agent_id", "pos")
    return updates.validate_updates(u.where("agent_id % 6 <> 5"), v.coords(spark), 64, agents=v.client_meta(spark, d), masks=masks)


@query("select district_id, agent_id, sha256(case when agent_id % 2 = 0 then 'fc.bias(32,)torch.float32fc.weight(8, 4)torch.float32' else 'fc.weight(8, 4)torch.float32' end) as schema_hash from client_meta")
def state_schema_hash(spark: SparkSession, d: str) -> DataFrame:
    u = v.updates(spark, d)
    kinds = u.select("pos").distinct().select("pos", F.when(F.col("pos") < 32, "fc.weight").otherwise("fc.bias").alias("key"), F.when(F.col("pos") < 32, "(8, 4)").otherwise("(32,)").alias("shape"), F.lit("torch.float32").alias("dtype"))
    return updates.schema_hash(u.where("pos < 32 or agent_id % 2 = 0"), shapes=kinds)


@query(f"select household_id, ts, {_r('kwh', 'kwh')} from imputed")
def sampling_input(spark: SparkSession, d: str) -> DataFrame:
    return etl.filled(v.meter(spark, d), v.households(spark, d), v.weather(spark, d)).select("household_id", "ts", "kwh")


@query("select agent_id, 1 + agent_id % 3 as n, '[' || agent_id || ',' || (agent_id % 3) || ']' as pair from client_meta where agent_id % 50 = 0")
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    """A program's own rows, a few for each fiftieth agent, with a nested value."""
    path = _folder(spark)
    ids = [r["agent_id"] for r in v.client_meta(spark, d).where("agent_id % 50 = 0").select("agent_id").collect()]
    writers.append_rows(spark, [{"agent_id": i, "n": 1 + i % 3, "pair": [i, i % 3]} for i in ids], path, "agent_id bigint, n bigint, pair array<bigint>")
    return spark.read.parquet(path)


@query(f"select agent_id, n_samples, {_r('l2', 'loss')} from norms join client_meta using (district_id, agent_id)")
def read_metric_json(spark: SparkSession, d: str) -> DataFrame:
    """Reports of all agents as JSON files, a broken one among them."""
    path = _folder(spark)
    known = updates.l2_norm(v.updates(spark, d)).join(v.client_meta(spark, d), ["district_id", "agent_id"]).select("agent_id", "n_samples", F.col("l2").alias("loss"))
    known.groupBy("agent_id").agg(F.to_json(F.first(F.struct("*"))).alias("value")).select("value").write.text(f"{path}/good")
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{path}/bad")
    return readers.read_metric_json(spark, f"{path}/*", "agent_id bigint, n_samples bigint, loss double", many=True)


@query()
def sampling_job(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    etl.sampling_job(spark, v.meter(spark, d), 12, 3, 1, path)
    return readers.read_manifest(spark, f"{path}/manifest")
