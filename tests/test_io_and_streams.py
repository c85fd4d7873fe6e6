"""Files, published versions and streams against their batch twins."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterflow.operators import control, prepare, updates
from meterflow.plans import etl, increments
from meterflow.plans.federated import RoundConfig, district_deltas
from meterflow.sources import readers, writers
from meterflow.sources.outbox import Outbox
from meterflow.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def raw(tmp_path):
    meter, weather = tmp_path / "meter", tmp_path / "weather"
    meter.mkdir()
    weather.mkdir()
    for h in ("H1", "H2"):
        lines = ["Group;Household_ID;Timestamp;kWh_received_Total;AffectsTimePoint"]
        lines += [f"g;{h};{(T0 + dt.timedelta(minutes=15 * i)).isoformat()}+00:00;{'bad' if i == 3 else 1.5};x" for i in range(40) if i != 7]
        (meter / f"{h}.csv").write_text("\n".join(lines))
    rows = ["Weather_ID;Timestamp;Temperature_avg_hourly;Humidity_avg_hourly;Sunshine_duration_hourly"]
    rows += [f"W1;{(T0 + dt.timedelta(hours=i)).isoformat()};{i};50;0" for i in range(8)]
    (weather / "w.csv").write_text("\n".join(rows))
    (tmp_path / "households.csv").write_text("Household_ID;Weather_ID\nH1;W1\nH1;W1\n")
    return tmp_path


def test_etl_publishes_a_version(spark, raw):
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    root = str(raw / "store")
    assert writers.resolve_current(spark, root) == root
    path = etl.etl_job(spark, str(raw / "meter"), str(raw / "weather"), str(raw / "households.csv"), root, "r1")
    assert writers.resolve_current(spark, root) == path
    made = readers.read_features(spark, path)
    assert made.count() == 80 and set(etl.EXTENDED) <= set(made.columns)
    assert made.where("household_id = 'H1'").agg(F.sum("load_missing")).first()[0] == 2
    assert {r.household_id for r in readers.discover_partitions(spark, path).collect()} == {"H1", "H2"}
    assert readers.read_features(spark, path, ["H2"], ["household_id", "kwh"]).count() == 40
    layout = readers.layout_stats(spark, path).first()
    assert 1 <= layout.n_files <= 64 and layout.n_bytes > 0
    etl.etl_job(spark, str(raw / "meter"), str(raw / "weather"), str(raw / "households.csv"), root, "r2")
    assert writers.resolve_current(spark, root).endswith("runs/r2")
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_features(made, path)
    for bad in ("", ".", "..", "a/b"):
        with pytest.raises(ValueError, match="run id"):
            writers.publish_version(made, root, bad)
    Path(root, ".CURRENT.crc").unlink(missing_ok=True)
    Path(root, "CURRENT").write_text("gone")
    with pytest.raises(FileNotFoundError):
        writers.resolve_current(spark, root)


def test_a_store_opens_only_the_files_of_its_households(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    rows = spark.range(60_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900)).cast("long").alias("household_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("kwh"))
    rows = rows.unionByName(spark.createDataFrame([(None, T0, 1.0)], rows.schema))
    path = str(tmp_path / "store")
    writers.write_features(rows, path, 16, 24)
    files = len(spark.read.parquet(path).inputFiles())
    assert 16 <= files <= 24 + 16 and readers.read_features(spark, path).count() == 60_001
    for some in (["1", "2", "3"], ["7"], ["nobody"], []):
        got = readers.read_features(spark, path, some)
        assert sorted(r.kwh for r in got.collect()) == sorted(r.kwh for r in rows.where(F.col("household_id").cast("string").isin(some)).collect())
        if some == ["1", "2", "3"]:
            assert len(got.inputFiles()) <= 6 and got.columns == ["household_id", "ts", "kwh"]
    # A household of a third of the rows lies in several files.
    assert len(readers.zone_files(spark, path, ["7"])) > 4
    writers.write_features(rows.where("household_id < 90"), f"{path}-small", 16, 24)
    assert len(spark.read.parquet(f"{path}-small").inputFiles()) <= 24 + 16


def test_increments_equal_one_run(spark, tmp_path):
    rng = random.Random(9)
    rows = [(h, T0 + dt.timedelta(minutes=5 * i), None if rng.random() < 0.1 else rng.random() * 5) for h in (1, 2, 3) for i in range(12 * 24 * 5) if rng.random() < 0.4 and not (h == 2 and 300 < i < 900) and not (h == 3 and i < 500)]
    meter = spark.createDataFrame(rows, "household_id long, ts timestamp_ntz, kwh double")
    households = spark.createDataFrame([(1, "W1"), (2, "W2")], "household_id long, weather_id string")
    weather = spark.createDataFrame([(w, T0 + dt.timedelta(hours=k), float(k), None if k % 4 else 1.0, 0.5) for w in ("W1", "W2") for k in range(120) if k % 7], "weather_id string, ts timestamp_ntz, temperature double, humidity double, sunshine double")
    bounds = spark.createDataFrame([(1, 0.3, 4.5), (2, 0.1, 4.9)], "household_id long, lo double, hi double")
    want = {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in etl.features(meter, households, weather, bounds=bounds).select(*increments.ROW).collect()}
    root = str(tmp_path / "store")
    assert increments.runs(spark, root) == []
    for day in range(5):
        part = meter.where((F.col("ts") >= F.lit(T0 + dt.timedelta(days=day))) & (F.col("ts") < F.lit(T0 + dt.timedelta(days=day + 1))))
        if day == 3:  # what comes again is left out
            part = part.unionByName(meter.where(F.col("ts") < F.lit(T0 + dt.timedelta(hours=30))))
        increments.add_increment(root, f"day-{day}", part, households, weather, bounds)
    assert increments.runs(spark, root) == [f"day-{k}" for k in range(5)]
    got = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in increments.read_increments(spark, root).select(*increments.ROW).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.household_id for r in increments.read_increments(spark, root, ["2"]).collect()} == {2}
    with pytest.raises(Exception, match="(?i)already exists"):
        increments.add_increment(root, "day-4", meter.limit(0), households, weather, bounds)


def test_an_increment_is_computed_once_and_leaves_earlier_values_as_they_are(spark):
    meter = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=15 * i), float(i)) for i in range(8) if i != 5], "household_id long, ts timestamp_ntz, kwh double")
    households = spark.createDataFrame([(1, "W1")], "household_id long, weather_id string")
    weather = spark.createDataFrame([("W1", T0, 1.0, 1.0, 1.0)], "weather_id string, ts timestamp_ntz, temperature double, humidity double, sunshine double")
    limits = lambda hi: spark.createDataFrame([(1, 0.0, hi)], "household_id long, lo double, hi double")
    early = meter.where(F.col("ts") < F.lit(T0 + dt.timedelta(minutes=60)))
    first, state = increments.increment(early, households, weather, limits(100.0))
    rows, after = increments.increment(meter, households, weather, limits(2.0), state)
    assert [r.kwh for r in first.orderBy("ts").collect()] == [0.0, 1.0, 2.0, 3.0]
    # Other bounds change what is new only; the slot that is missing has the mean of what was seen.
    assert [(r.kwh, r.lag_1, r.load_missing) for r in rows.orderBy("ts").collect()] == [(2.0, 3.0, 0), (2.0, 2.0, 1), (2.0, 2.0, 0), (2.0, 2.0, 0)]
    assert [tuple(r) for r in after.select("n_seen", "sum_seen", "tail").collect()] == [(7, 23.0, [0.0, 1.0, 2.0, 3.0, 2.0, 2.0, 2.0, 2.0])]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_an_increment_is_written_once_as_it_is_made(spark, tmp_path, monkeypatch):
    """No window over filled rows, no second deal of them; by either way to the weather; odd households go on, too."""
    rng = random.Random(3)
    rows = [(h, T0 + dt.timedelta(minutes=5 * i), None if rng.random() < 0.1 else rng.random() * 5) for h in (None, 1, 2, 30, 4) for i in range(12 * 24 * 3) if rng.random() < 0.3 and not (h == 4 and i > 300)]
    meter = spark.createDataFrame(rows, "household_id long, ts timestamp_ntz, kwh double")
    households = spark.createDataFrame([(1, "W1"), (2, "W2"), (30, "W1")], "household_id long, weather_id string")
    weather = spark.createDataFrame([(w, T0 + dt.timedelta(hours=k), float(k), float("nan") if k % 4 else 1.0, 0.5) for w in ("W1", "W2") for k in range(72) if k % 7], "weather_id string, ts timestamp_ntz, temperature double, humidity double, sunshine double")
    bounds = spark.createDataFrame([(1, 0.3, 4.5), (2, 0.1, 4.9), (None, 2.0, 3.0)], "household_id long, lo double, hi double")
    told = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*increments.ROW).collect())
    want = told(etl.features(meter, households, weather, bounds=bounds))
    plan = increments._made(meter, households, weather, bounds, None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange rangepartitioning") == 1
    for most in (increments.HOURS, 10):
        monkeypatch.setattr(increments, "HOURS", most)
        root = str(tmp_path / f"store-{most}")
        for day in range(3):
            increments.add_increment(root, f"day-{day}", meter.where((F.col("ts") >= F.lit(T0 + dt.timedelta(days=day))) & (F.col("ts") < F.lit(T0 + dt.timedelta(days=day + 1)))), households, weather, bounds)
        assert told(increments.read_increments(spark, root)) == want
        zones = spark.read.parquet(f"{root}/runs/day-0/rows/{writers.ZONES}")
        assert zones.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{root}/runs/day-0/rows").count()
        assert {r.household_id for r in increments.read_increments(spark, root, ["30", "4"]).collect()} == {30, 4}
        state = spark.read.parquet(f"{root}/runs/day-2/state")
        assert sorted(str(r[0]) for r in state.select("household_id").collect()) == ["1", "2", "30", "4", "None"]
    # What is not finite is refused, and nothing of it stays.
    huge = spark.createDataFrame([(1, T0 + dt.timedelta(days=4, minutes=15 * i), 1.7e308) for i in range(2)], "household_id long, ts timestamp_ntz, kwh double")
    with pytest.raises(ValueError, match="2 rows are not finite"):
        increments.add_increment(root, "huge", huge, households, weather, bounds.limit(0))
    assert not (tmp_path / f"store-{most}/runs/huge/rows").exists() and increments.runs(spark, root)[-1] == "day-2"


def test_missing_columns_fail_loudly(spark, raw):
    (raw / "meter" / "H1.csv").write_text("Household_ID;Timestamp\nH1;x\n")
    (raw / "meter" / "H2.csv").unlink()
    with pytest.raises(ValueError, match="kWh_received_Total"):
        readers.read_meter(spark, str(raw / "meter"))


def test_manifests_audits_and_rounds(spark, tmp_path):
    chosen = spark.createDataFrame([("H1", 0, 1), ("H2", 1, 1)], "household_id string, cluster int, rank_in_cluster int")
    writers.write_manifest(chosen, str(tmp_path / "m"))
    assert readers.read_manifest(spark, str(tmp_path / "m")).exceptAll(chosen).count() == 0
    schema = "district_id string, round_id long, agent_id long"
    assert readers.read_audit(spark, str(tmp_path / "a"), schema).count() == 0
    for r in (1, 2):
        writers.append_audit(spark.createDataFrame([("D1", r, 5)], schema), str(tmp_path / "a"))
    assert readers.read_audit(spark, str(tmp_path / "a"), schema).count() == 2
    writers.append_rows(spark, [{"d": None, "x": [1, 2]}, {"d": "D", "x": []}], str(tmp_path / "r"), "d string, x array<int>", ("d",))
    assert {(r.d, r.x) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("null", "[1,2]"), ("D", "[]")}
    w = spark.createDataFrame([(0, 1.0)], "pos int, value double")
    writers.checkpoint_round(w, str(tmp_path / "w"), 4)
    assert readers.read_metric_json(spark, _reports(tmp_path), "agent_id long, loss double").count() == 1
    assert writers.resume_round(spark, str(tmp_path / "w"), 5).first().value == 1.0


def _reports(folder):
    (folder / "one.report").write_text(json.dumps({"agent_id": 1, "loss": 0.5}))
    (folder / "two.report").write_text("{broken")
    return str(folder / "*.report")


# --- streams


EVENTS = "household_id long, ts timestamp, event_id long, kwh double"


def parts(spark, folder, rows, schema, n=3, ends=None):
    """n files of rows in order, as a stream that reads one a batch; ``ends`` is a last row that moves the watermark on."""
    pieces = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)] + ([[ends]] if ends else [])
    for i, piece in enumerate(pieces):
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        for f in Path(f"{folder}/in/{i}").glob("part-*"):
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def drained(df, folder, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return df.sparkSession.table(name)


def readings(n=120):
    return [(i % 2, T0 + dt.timedelta(minutes=7 * i), i, 1.0 + (i % 5) * 0.01 + 8.0 * (i in (90, 101))) for i in range(n)]


def mixed(rows, seed=1):
    """The rows in any order, with readings that lack a value or a household."""
    rows = [*rows, (0, T0 + dt.timedelta(minutes=1), 900, None), (1, T0 + dt.timedelta(minutes=2), 901, float("nan")), (None, T0, 902, 5.0)]
    random.Random(seed).shuffle(rows)
    return rows


#: A row that has only a time, after all others; all rows are in time for a lateness of a day.
END = (None, T0 + dt.timedelta(days=30), None, None)


def test_stream_drift_equals_batch_in_any_order(spark, tmp_path):
    rows = mixed(readings())
    got = drained(jobs.stream_drift(parts(spark, tmp_path, rows, EVENTS, 5, END), "1 day"), tmp_path, "drift")
    want = control.drift_flags(spark.createDataFrame(rows, EVENTS).where("household_id is not null"))
    key = lambda d: sorted((r.household_id, r.ts, r.event_id, r.kwh, r.drift) for r in d.collect())
    assert key(got) == key(want) and len(key(want)) == 120 and any(r[4] for r in key(want))


def test_what_waits_is_released_as_the_watermark_moves(spark, tmp_path):
    rows = readings()
    got = drained(jobs.stream_recent(parts(spark, tmp_path, rows, EVENTS, 5), "70 minutes"), tmp_path, "released").collect()
    # Several releases a household, each once its rows can no longer be overtaken.
    assert len(got) > 6 and max(r.ts for r in got) <= rows[-1][1] - dt.timedelta(minutes=70)
    for h in (0, 1):
        mine = sorted((r.ts, r.recent) for r in got if r.household_id == h)
        assert all(recent == [r[3] for r in rows if r[0] == h and r[1] <= ts][-96:] for ts, recent in mine)


def test_stream_resample_and_late_rows(spark, tmp_path):
    rows = readings()
    got = drained(jobs.stream_resample(parts(spark, tmp_path, rows, EVENTS), "10 minutes"), tmp_path, "resampled")
    plain = spark.createDataFrame(rows, EVENTS).withColumn("weather_id", F.lit("W"))
    want = {(r.household_id, r.ts): round(r.kwh, 9) for r in prepare.resample_15min(plain).collect()}
    found = {(r.household_id, r.ts): round(r.kwh, 9) for r in got.collect()}
    assert found.items() <= want.items() and len(found) > len(want) - 8


def test_late_rows_go_aside(spark, tmp_path):
    rows = [(0, T0 + dt.timedelta(minutes=m), i, 1.0) for i, m in enumerate([0, 10, 5, 200, 130, 140, 150, 199, 400, 139, 340, 341, 399])] + [(0, None, 99, 1.0)]
    query = lambda: jobs.late_policy(parts(spark, tmp_path, rows, EVENTS, 4) if not (tmp_path / "in").exists() else spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "1 hour", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
    query()
    top, want = None, {}
    for i in range(4):
        piece = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        for r in piece:
            want[r[2]] = r[1] is None or (top is not None and r[1] <= top - dt.timedelta(hours=1))
        top = max([*([top] if top else []), *[r[1] for r in piece if r[1]]])
    read = lambda k: [r.event_id for r in spark.read.parquet(f"{tmp_path}/out/{k}").collect()]
    assert {True, False} == set(want.values())
    assert sorted(read("fine")) == sorted(k for k, late in want.items() if not late) and sorted(read("late")) == sorted(k for k, late in want.items() if late)
    query()  # nothing new
    assert len(read("fine")) + len(read("late")) == len(rows)


UPLOADS = "district_id long, seq long, ts timestamp, agent_id long, round_id long, n_samples long, vector array<double>, mask array<boolean>"


def upload(seq, agent, round_id, vector=(1.0,), district=0, mask=None, n=1):
    return (district, seq, T0 + dt.timedelta(minutes=seq), agent, round_id, n, vector if vector is None else list(vector), mask)


def cohort_rows(spark, folder, rows, agents, n=3):
    expected = spark.createDataFrame([(0, a) for a in agents], "district_id long, agent_id long")
    stream = parts(spark, folder, rows, UPLOADS, n, (None, None, T0 + dt.timedelta(days=30), None, None, None, None, None))
    return jobs.stream_cohort(stream, expected, "1 hour", "30 minutes")


def test_stream_cohort_closes_rounds(spark, tmp_path):
    rows = [upload(1, 1, 0, [1.0]), upload(2, 1, 0, [3.0]), upload(3, 2, 0, [5.0], n=0), upload(4, 1, 0), upload(5, 1, 5), upload(6, 9, 1), upload(7, 2, 1, None), upload(8, 2, 1, []), upload(9, 2, 1, [7.0, 8.0], mask=[True, False], n=4), upload(400, 1, 2, [2.0]), upload(401, 1, 1), upload(402, 1, 0, district=7)]
    got = drained(cohort_rows(spark, tmp_path, rows, [1, 2], 5), tmp_path, "cohort").collect()
    assert sorted((r.district_id, r.round_id, r.status, r.agent_id) for r in got if r.status in ("stale", "future", "unknown", "invalid")) == [(0, 0, "stale", 1), (0, 1, "invalid", 2), (0, 1, "invalid", 2), (0, 1, "stale", 1), (0, 1, "unknown", 9), (0, 5, "future", 1), (7, 0, "unknown", 1)]
    assert sorted((r.round_id, r.status, r.n, r.missing) for r in got if r.n) == [(0, "complete", 2, []), (1, "deadline", 1, [1]), (2, "deadline", 1, [2])]
    assert sorted((r.round_id, r.agent_id, r.n_samples, r.vector, r.mask) for r in got if r.status == "upload") == [(0, 1, 1, [3.0], [True]), (0, 2, 1, [5.0], [True]), (1, 2, 4, [7.0, 8.0], [True, False]), (2, 1, 1, [2.0], [True])]


def test_stream_rounds_aggregate_as_a_round_does(spark, tmp_path):
    rng = random.Random(4)
    rows, seq = [], 0
    for k in range(2):
        for a in range(7 if k == 0 else 3):
            seq += 1
            rows.append(upload(seq, a, k, [rng.gauss(0, 1) for _ in range(4)], mask=[a != p for p in range(4)], n=a + 1))
    config = RoundConfig(clip=1.2)
    jobs.stream_rounds(cohort_rows(spark, tmp_path, rows, range(7)), f"{tmp_path}/out", f"{tmp_path}/check", config).awaitTermination(180)
    got = {(r.round_id, r.pos): (round(r.value, 12), r.contributed) for r in spark.read.parquet(f"{tmp_path}/out/deltas").collect()}
    plain = spark.createDataFrame([(0, r[3], p, v) for r in rows if r[4] == 0 for p, (v, m) in enumerate(zip(r[6], r[7], strict=True)) if m], "district_id long, agent_id long, pos int, value double")
    want, audit = district_deltas(plain, spark.createDataFrame([(0, a, a + 1) for a in range(7)], "district_id long, agent_id long, n_samples long"), config)
    assert got == {(0, r.pos): (round(r.value, 12), r.contributed) for r in want.collect()}  # the second round has too few
    assert {(r.agent_id, round(r.krum_score, 9), r.accepted) for r in spark.read.parquet(f"{tmp_path}/out/audit").collect()} == {(r.agent_id, round(r.krum_score, 9), r.accepted) for r in audit.collect()}


def test_stream_convergence_equals_batch(spark, tmp_path):
    rows = [(d, i, 0.1 if (i + d) % 4 else 1.0) for i in range(9) for d in (0, 1)]
    schema = "district_id long, round_id long, drift double"
    got = drained(jobs.stream_convergence(parts(spark, tmp_path, rows, schema), 0.5, 2), tmp_path, "convergence")
    want = updates.converged_rounds(spark.createDataFrame(rows, schema), 0.5, 2, ("district_id",))
    key = lambda d: sorted((r.district_id, r.round_id, r.stable_rounds, r.converged) for r in d.collect())
    assert key(got) == key(want)


def test_stream_patterns_and_their_pool(spark, tmp_path):
    schema = "agent_id long, ts timestamp, event_id long, vector array<double>"
    rows = [(1, T0 + dt.timedelta(minutes=i), i, [float(i), 1.0]) for i in range(18)]
    random.Random(3).shuffle(rows)
    stream = parts(spark, tmp_path, rows, schema, 5, (None, T0 + dt.timedelta(days=9), None, None))
    got = drained(jobs.stream_patterns(stream, 4, 2, "1 day"), tmp_path, "patterns")
    assert sorted((r.block, r.vector, r.replaces) for r in got.collect()) == [(0, [1.5, 1.0], None), (1, [5.5, 1.0], None), (2, [9.5, 1.0], 0), (3, [13.5, 1.0], 1)]
    assert sorted(r.block for r in jobs.newest_patterns(spark.createDataFrame(got.collect(), got.schema)).collect()) == [2, 3]


def test_stream_actions_equal_batch_in_any_order(spark, tmp_path):
    rows = [(*r, None if r[2] is None or r[2] % 3 == 0 or r[2] < 9 else 2.0) for r in mixed(readings(420))]
    schema = EVENTS + ", predicted double"
    got = drained(jobs.stream_actions(parts(spark, tmp_path, rows, schema, 5, (*END, None)), "3 days"), tmp_path, "acts").collect()
    batch = spark.createDataFrame(rows, schema).where("household_id is not null")
    want = control.adaptive_capacity(batch, forecast="predicted").collect()
    assert {r.event_id: r.capacity for r in got} == {r.event_id: r.capacity for r in want} and len(got) == len(want) == 420
    assert {tuple(r.actions) for r in got if r.predicted is None} == {("MONITOR",)} and all(r.capacity is None for r in got if r.predicted is None)
    assert len({r.capacity for r in got}) > 2


class Kept:
    """State of one group in memory, for counting calls."""

    def __init__(self):
        self.calls, self.value, self.rows, self.map, self.timers = 0, None, [], {}, []

    def _state(self, *_):
        return self

    getValueState = getListState = getMapState = _state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls, self.timers = self.calls + 1, [*self.timers, at]

    def exists(self):
        return self.value is not None

    def appendValue(self, row):  # noqa: N802
        self.calls, self.rows = self.calls + 1, [*self.rows, row]

    def clear(self):
        self.calls, self.rows, self.map = self.calls + 1, [], {}

    def updateValue(self, key, value):  # noqa: N802
        self.calls, self.map = self.calls + 1, self.map | {key: value}

    def iterator(self):
        self.calls += 1
        return iter(self.map.items())


class Cell(Kept):
    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


class Waiting(Kept):
    def get(self):
        self.calls += 1
        return iter(self.rows)


def test_households_of_a_group_share_calls_of_state():
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from meterflow.streaming import ordered

    job, waiting, cell, timers = ordered.Recent(), Waiting(), Cell(), Kept()
    job.key, timers.getListState, timers.getValueState = "household_id", lambda *_: waiting, lambda *_: cell
    job.init(timers)
    mark = lambda m: SimpleNamespace(getCurrentWatermarkInMs=lambda: m)
    got = {}
    for batch in range(3):
        df = pd.DataFrame([(h, pd.Timestamp(60 * i, unit="s"), 1000 * h + i, float(h + i)) for i in range(10 * batch, 10 * batch + 10) for h in range(-32, 32)], columns=["household_id", "ts", "event_id", "kwh"])
        list(job.handleInputRows((0,), iter([df.sample(frac=1, random_state=batch)]), mark(0)))
        for out in job.handleExpiredTimer((0,), mark(60_000 * (10 * batch + 4)), None):
            got |= {(r.household_id, r.ts): list(r.recent) for r in out.itertuples()}
    assert waiting.calls + cell.calls + timers.calls <= 3 * 10  # 64 households, three batches
    assert len(got) == 3 * 64 and all(recent == [float(h + i) for i in range(len(recent))] and len(recent) == ts.minute + 1 for (h, ts), recent in got.items())
    capacity = ordered.Capacity()
    cells = {}
    import pyarrow as pa

    due = pa.table({"key": [1, 1, 2], "at": [0, 1, 0], "event_id": [1, 2, 3], "kwh": [3.0, 4.0, 5.0], "predicted": pa.array([None, 1.0, 2.0], pa.float64())})
    out = capacity.release(due, [(1, 0, 2), (2, 2, 3)], cells)
    assert np.isnan(out.capacity[0]) and out.capacity[1:].tolist() == [1.2, 1.2] and [c[0].tolist() for c in cells.values()] == [[4.0], [5.0]]


def test_a_cohorts_state_is_written_once_a_batch():
    import numpy as np
    import pandas as pd

    job, uploads, cell, timers = jobs._Cohort(3_600_000, 0), Kept(), Cell(), Kept()
    timers.getValueState, timers.getMapState = lambda *_: cell, lambda *_: uploads
    job.init(timers)
    rows = [(0, i, pd.Timestamp(60 * i, unit="s"), i % 4, i // 4, 1, np.array([float(i)]), None, np.arange(4)) for i in range(402)]
    df = pd.DataFrame(rows, columns=["district_id", "seq", "ts", "agent_id", "round_id", "n_samples", "vector", "mask", "expected"])
    out = next(iter(job.handleInputRows((0,), iter([df]), None)))
    assert (out.status == "complete").sum() == 100 and (out.status == "upload").sum() == 400
    assert {k[0]: v for k, v in uploads.map.items()} == {0: (1, [400.0], [True]), 1: (1, [401.0], [True])} and cell.value[0] == 100
    assert timers.timers == [400 * 60_000 + 3_600_000] and uploads.calls + cell.calls + timers.calls < 10


def test_outbox_delivers_once_over_lost_checkpoints(spark, tmp_path):
    schema = "round_id long, agent_id long, seq long, value double"
    rows = [(i // 4 % 5, i % 4, i, float(i)) for i in range(36)] + [(None, 1, 99, 0.0)]
    outbox = Outbox(f"{tmp_path}/out")
    keys = lambda: sorted((r.round_id, r.agent_id) for r in outbox.read(spark, schema).collect())
    assert keys() == []
    for n in (3, 2):  # other batches, a checkpoint of its own
        (tmp_path / f"s{n}").mkdir()
        jobs.stream_outbox(parts(spark, tmp_path / f"s{n}", rows, schema, n), outbox, f"{tmp_path}/check{n}").awaitTermination(180)
        assert keys() == sorted({(r[0], r[1]) for r in rows if r[0] is not None})
    first = {(r.round_id, r.agent_id): r.seq for r in outbox.read(spark).collect()}
    assert first[0, 0] == 0 and first[4, 3] == 19  # the first delivery of a key stays


def test_outbox_ignores_what_was_not_committed(spark, tmp_path):
    schema = "round_id long, agent_id long, seq long, value double"
    outbox = Outbox(f"{tmp_path}/out")
    spark.createDataFrame([(7, 7, 1, 0.0)], schema).write.parquet(f"{tmp_path}/out/data/lost")  # ended before its line
    outbox.deliver(spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 2.0), (9, 1, 1, 3.0)], schema))
    outbox.deliver(spark.createDataFrame([(1, 1, 3, 4.0), (5, 5, 1, 5.0)], schema))
    assert sorted((r.round_id, r.value) for r in outbox.read(spark).collect()) == [(1, 2.0), (5, 5.0), (9, 3.0)]
    assert not outbox._commit(spark, 1, "elsewhere", "0", "0")  # the number is taken
    assert [e["number"] for e in outbox.entries(spark)] == [0, 1]


def test_weather_comes_as_a_stream_too(spark, tmp_path):
    rows = [(*r, f"W{r[0]}") for r in readings(60)]
    random.Random(5).shuffle(rows)
    hours = [(f"W{w}", T0 + dt.timedelta(hours=h), 10.0 * w + h, None, None) for h in range(6) for w in (0, 1) if h % 3 != 1]
    random.Random(6).shuffle(hours)
    schema, weather = EVENTS + ", weather_id string", "weather_id string, ts timestamp, temperature double, humidity double, sunshine double"
    for k in ("r", "w"):
        (tmp_path / k).mkdir()
    joined = jobs.stream_weather_join(parts(spark, tmp_path / "r", rows, schema, 4, (*END, None)), parts(spark, tmp_path / "w", hours, weather, 3, (None, END[1], None, None, None)), "1 day", "1 day")
    got = sorted(((r.event_id, r.temperature) for r in drained(joined, tmp_path, "weathered").collect()), key=str)
    want = sorted(((r[2], next((h[2] for h in hours if h[0] == r[4] and h[1] == r[1].replace(minute=0)), None)) for r in rows), key=str)
    assert got == want and any(t is None for _, t in want)


def test_sampling_job_writes_profiles_and_manifest(spark, tmp_path):
    from meterflow.plans.etl import sampling_job

    rows = [(h, T0 + dt.timedelta(minutes=15 * i), float(h % 3) * 5 + i % 2) for h in range(24) for i in range(8)]
    meter = spark.createDataFrame(rows, "household_id long, ts timestamp_ntz, kwh double")
    chosen = sampling_job(spark, meter, 9, 3, 1, str(tmp_path)).collect()
    assert len(chosen) == 9 and {r.cluster for r in chosen} == {0, 1, 2}
    assert readers.read_manifest(spark, f"{tmp_path}/manifest").count() == 9
    assert spark.read.parquet(f"{tmp_path}/profiles").count() == 24
