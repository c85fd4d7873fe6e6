"""Operators on small frames with known results."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.functions.columns import safe_float, slot_clock, tariff_band
from meterflow.operators import cohort, control, evaluate, memory, prepare, report, sequence, series, updates
from meterflow.plans import federated, learn

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def readings(spark, rows):
    return spark.createDataFrame(rows, "household_id long, weather_id string, ts timestamp_ntz, kwh double")


# --- preparation


def test_required_columns_are_named(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="meter: missing columns .*kwh.*found .*id"):
        prepare.require_columns(df, ["id", "kwh"], "meter")
    assert prepare.schema_difference(df, ["id"]) == []


def test_local_time_follows_daylight_rules(spark):
    df = spark.createDataFrame([("2024-01-15 12:00:00",), ("2024-07-15 12:00:00",), ("2024-07-15T12:00:00+00:00",), ("nonsense",)], "ts string")
    got = [r.ts for r in prepare.normalize_tz(df, "ts", "Europe/Berlin").select(F.col("ts").cast("timestamp_ntz").alias("ts")).collect()]
    assert got == [dt.datetime(2024, 1, 15, 11), dt.datetime(2024, 7, 15, 10), dt.datetime(2024, 7, 15, 12), None]


def test_gap_filling_keeps_households_without_metadata(spark):
    df = readings(spark, [(1, None, at(0), 2.0), (1, None, at(3), 1.0), (1, None, at(45), 4.0), (2, "W1", at(20), None)])
    grid = {(r.household_id, r.ts): r.kwh for r in prepare.gap_fill(prepare.resample_15min(df)).collect()}
    assert grid == {(1, at(0)): 3.0, (1, at(15)): None, (1, at(30)): None, (1, at(45)): 4.0, (2, at(15)): None}


def test_imputation_is_causal(spark):
    df = readings(spark, [(1, "W", at(15 * i), x) for i, x in enumerate([None, 2.0, None, 4.0, None])])
    by = lambda d: [r.kwh for r in d.orderBy("ts").collect()]
    assert by(prepare.causal_impute(df)) == [0.0, 2.0, 2.0, 4.0, 3.0]
    assert by(prepare.ffill_impute(df)) == [0.0, 2.0, 2.0, 4.0, 4.0]


def test_lags_and_rolls(spark):
    df = readings(spark, [(1, "W", at(15 * i), float(i)) for i in range(6)])
    got = prepare.rolling_features(prepare.lag_features(df)).orderBy("ts").collect()
    assert [r.lag_1 for r in got] == [0, 0, 1, 2, 3, 4] and [r.lag_4 for r in got] == [0, 1, 2, 3, 0, 1]
    assert got[5].roll_mean_4 == 3.5 and abs(got[5].roll_std_4 - math.sqrt(1.25)) < 1e-12 and got[5].roll_max_96 == 5
    back = prepare.lag_features_backfill(df).orderBy("ts").collect()
    assert [r.lag_4 for r in back] == [0, 0, 0, 0, 0, 1] and back[0].roll_std_4 == 0


def test_weather_is_carried_to_the_last_reading_only(spark):
    w = spark.createDataFrame([("W", at(0), 1.0, None, 0.0), ("W", at(60), 2.0, 5.0, 0.0)], "weather_id string, ts timestamp_ntz, temperature double, humidity double, sunshine double")
    df = readings(spark, [(1, "W", at(m), 0.0) for m in (0, 45, 60, 75)] + [(2, None, at(0), 0.0)])
    got = {(r.household_id, r.ts): (r.temperature, r.humidity) for r in prepare.weather_asof_join(df, w).collect()}
    assert got == {(1, at(0)): (1.0, None), (1, at(45)): (1.0, None), (1, at(60)): (2.0, 5.0), (1, at(75)): (None, None), (2, at(0)): (None, None)}
    hourly = {r.ts: r.temperature for r in prepare.weather_hour_join(df.where("household_id = 1"), w).collect()}
    assert hourly == {at(0): 1.0, at(45): 1.0, at(60): 2.0, at(75): 2.0}


def test_finite_gate_and_safe_float(spark):
    df = spark.createDataFrame([(1.0, "2.5"), (float("nan"), "x")], "a double, b string")
    with pytest.raises(ValueError, match="1 rows"):
        prepare.finite_gate(df, ["a"])
    assert [r.b for r in df.select(safe_float("b", 9.0).alias("b")).collect()] == [2.5, 9.0]


def test_clip_needs_a_positive_span(spark):
    df = spark.createDataFrame([(5.0, 1.0, 3.0), (5.0, -2.0, 0.0), (-1.0, -2.0, 4.0)], "kwh double, lo double, hi double")
    assert [r.kwh for r in prepare.clip_bounds(df, "kwh", "lo", "hi").collect()] == [3.0, 5.0, 0.0]


def test_clock_and_tariff(spark):
    got = spark.createDataFrame([(0,), (49,), (70,), (95,), (None,)], "s int").select(slot_clock("s").alias("a"), slot_clock("s", style="12h").alias("b"), tariff_band("s").alias("p")).collect()
    assert [r.a for r in got] == ["00:00", "12:15", "17:30", "23:45", None]
    assert [r.b for r in got] == ["12:00 AM", "12:15 PM", "5:30 PM", "11:45 PM", None]
    assert [r.p for r in got][:4] == [0.10, 0.20, 0.32, 0.10]


# --- cohorts


def clusters(spark, sizes):
    return spark.createDataFrame([(10_000 * c + i, c) for c, n in enumerate(sizes) for i in range(n)], "household_id long, cluster int")


@pytest.mark.parametrize(("sizes", "n", "want"), [((60, 30, 10), 10, {0: 4, 1: 3, 2: 3}), ((99, 1), 50, {0: 49, 1: 1}), ((1379, 27, 1), 30, {0: 15, 1: 14, 2: 1})])
def test_balanced_selection(spark, sizes, n, want):
    picked = cohort.balanced_select(clusters(spark, sizes), n, 1).collect()
    counts = {c: sum(r.cluster == c for r in picked) for c in want}
    assert sum(counts.values()) == n and len({r.household_id for r in picked}) == n
    if sizes[0] < 1000:
        assert counts == want
    else:
        assert counts[1] >= 10 and counts[2] == 1


def test_split_is_disjoint_and_covers(spark):
    got = cohort.stratified_split(clusters(spark, (10, 10, 10)), 24, 3, 3, 0)
    rows = got.collect()
    assert {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")} == {"train": 24, "val": 3, "test": 3}
    assert {r.cluster for r in rows if r.split == "val"} == {r.cluster for r in rows if r.split == "test"} == {0, 1, 2}
    assert cohort.split_disjointness(got).count() == 0
    with pytest.raises(ValueError, match="more households"):
        cohort.stratified_split(clusters(spark, (2, 2)), 3, 1, 1)


def test_hash_split_is_stable(spark):
    ids = spark.range(2000).withColumnRenamed("id", "k")
    a = cohort.hash_split(ids, "k", 0.2, 1)
    assert 300 < a.where("in_val").count() < 500
    assert a.exceptAll(cohort.hash_split(ids.repartition(7), "k", 0.2, 1)).count() == 0
    assert [r["size"] for r in cohort.district_sizes(spark, 10, 4).orderBy("district").collect()] == [3, 3, 2, 2]


def test_districts_mix_clusters(spark):
    got = cohort.assign_districts(cohort.balanced_select(clusters(spark, (6, 6)), 8, 0), 2).collect()
    assert all({r.cluster for r in got if r.district_id == d} == {0, 1} for d in ("D1", "D2"))


# --- updates


def vectors(spark, rows, district=0):
    return spark.createDataFrame([(district, a, p, float(x)) for a, v in rows.items() for p, x in enumerate(v)], "district_id long, agent_id long, pos int, value double")


def test_clip_and_norm(spark):
    got = updates.clip_updates(vectors(spark, {1: [3, 4], 2: [0.3, 0.4], 3: [0, 0]}), 1.0).collect()
    assert {(r.agent_id, r.pos): round(r.value, 9) for r in got} == {(1, 0): 0.6, (1, 1): 0.8, (2, 0): 0.3, (2, 1): 0.4, (3, 0): 0, (3, 1): 0}
    assert {r.agent_id: round(r.l2, 9) for r in got} == {1: 5.0, 2: 0.5, 3: 0.0}


def test_sparsify_keeps_the_largest(spark):
    marked = updates.topk_sparsify(vectors(spark, {1: range(100)}), 0.1)
    assert marked.where("kept").agg(F.sum("value")).first()[0] == 945
    assert updates.topk_sparsify(vectors(spark, {1: [1, 1]}), 0.1).where("kept").select("pos").first().pos == 0
    assert updates.sparsity(vectors(spark, {1: [0, 1, 0, 2]})).first().sparsity == 0.5


def test_error_feedback_sends_what_was_held_back(spark):
    u = vectors(spark, {1: [5, 4, 1]})
    sent, rest = updates.error_feedback(u, u.limit(0), 0.34)
    assert [(r.pos, r.value) for r in sent.collect()] == [(0, 5.0)]
    again, _ = updates.error_feedback(u, rest, 0.34)
    assert [(r.pos, r.value) for r in again.collect()] == [(1, 8.0)]


def plain_krum(states, f):
    """Scores over zero-filled vectors."""
    n, places = len(states), sorted({p for s in states for p in s})
    flat = [[s.get(p, 0.0) for p in places] for s in states]
    if f == 0 and n < 3:
        return [0.0] * n
    gaps = [sorted(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for j, b in enumerate(flat) if j != i) for i, a in enumerate(flat)]
    return [sum(g[: n - f - 2]) for g in gaps]


def sparse_updates(spark, states):
    return spark.createDataFrame([(1, i, p, float(v)) for i, s in enumerate(states) for p, v in s.items()], "district_id long, agent_id long, pos int, value double")


def test_distances_of_updates_with_absent_coordinates(spark):
    d = updates.pairwise_distance(sparse_updates(spark, [{0: 1, 2: 5}, {0: 1, 1: 5}, {700: 2}]), chunk=256)
    assert {(r.a, r.b): r.distance for r in d.collect()} == {(a, b): x for (i, j), x in {(0, 1): 50.0, (0, 2): 30.0, (1, 2): 30.0}.items() for a, b in ((i, j), (j, i))}


@pytest.mark.parametrize("f", [0, 1])
def test_krum_on_sparse_updates_against_a_plain_computation(spark, f):
    rng = random.Random(f)
    states = [{p: rng.choice([-1.0, 0.5, 2.0]) for p in rng.sample(range(600), 20)} for _ in range(7)]
    u = sparse_updates(spark, states)
    got = {r.agent_id: r.score for r in updates.krum_score(updates.pairwise_distance(u, chunk=64), f, agents=u).collect()}
    assert [got[i] for i in range(7)] == pytest.approx(plain_krum(states, f))


def test_an_attacker_of_one_coordinate_is_rejected(spark):
    honest = [{p: 0.1 * (p + i % 2) for p in range(8)} for i in range(4)]
    u = sparse_updates(spark, [*honest, {3: 1_000_000.0}])
    chosen = updates.multi_krum(updates.krum_score(updates.pairwise_distance(u), 1, agents=u), 1).collect()
    assert {r.agent_id: r.accepted for r in chosen} == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_cohorts_of_one_agent(spark):
    u = sparse_updates(spark, [{0: 1.0}])
    d = updates.pairwise_distance(u)
    assert [(r.agent_id, r.score) for r in updates.krum_score(d, 0, agents=u).collect()] == [(0, 0.0)]
    with pytest.raises(Exception, match="2f"):
        updates.krum_score(d, 1, agents=u).collect()
    with pytest.raises(ValueError, match="negative"):
        updates.krum_score(d, -1, agents=u)


def test_validation_and_schema_of_updates(spark):
    u = sparse_updates(spark, [{0: 1, 1: 2}, {0: float("nan")}, {0: 1}, {9: 1}])
    coords = spark.range(3).select(F.col("id").cast("int").alias("pos"))
    agents = spark.createDataFrame([(1, i) for i in range(5)], "district_id long, agent_id long")
    masks = u.where("agent_id <> 2").select("district_id", "agent_id", "pos").union(spark.createDataFrame([(1, 2, 1)], "district_id long, agent_id long, pos int"))
    got = {r.agent_id: (r.n, r.reason) for r in updates.validate_updates(u, coords, 5, agents=agents, masks=masks).collect()}
    assert got == {0: (2, None), 1: (1, "not_finite"), 2: (1, "mask_mismatch"), 3: (1, "unaligned"), 4: (0, "empty")}
    shapes = spark.createDataFrame([(0, "b", "(1,)", "f"), (1, "a", "(2, 1)", "f"), (9, "b", "(1,)", "f")], "pos int, key string, shape string, dtype string")
    same = {r.agent_id: r.schema_hash for r in updates.schema_hash(u, shapes=shapes).collect()}
    assert same[0] == hashlib.sha256(b"a(2, 1)fb(1,)f").hexdigest() and same[1] == same[2] == same[3] != same[0]


def test_running_max_and_sliding_quantile(spark):
    rng = random.Random(3)
    rows = [(h, T0 + dt.timedelta(minutes=15 * i), rng.choice([None, rng.random() * 9])) for h in (1, 2) for i in range(130)]
    got = prepare.running_max(spark.createDataFrame(rows, "household_id long, ts timestamp, kwh double"), 96).orderBy("household_id", "ts").collect()
    for i, r in enumerate(got):
        seen = [x for h, _, x in rows[max(0, i - 95) : i + 1] if h == r.household_id and x is not None]
        assert r.roll_max == (max(seen) if seen else None)
    x = np.array([rng.random() for _ in range(300)])
    want = [np.percentile(x[max(0, i - 39) : i + 1], 95) for i in range(300)]
    assert control.sliding_quantile(x, x[:0], 40, 0.95) == pytest.approx(want)
    assert control.sliding_quantile(x[100:], x[61:100], 40, 0.95) == pytest.approx(want[100:])


def test_adaptive_capacity_over_batches(spark):
    rng = random.Random(4)
    rows = [(h, T0 + dt.timedelta(minutes=i), float(rng.randint(0, 50)) / 10) for h in range(3) for i in range(150)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = control.adaptive_capacity(spark.createDataFrame(rows, "household_id long, ts timestamp, kwh double"), days=2, slots=20).orderBy("household_id", "ts").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, r in enumerate(got):
        k = i % 150
        seen = [x for _, _, x in rows[i - min(k, 39) : i + 1]]
        assert r.capacity == pytest.approx(1.2 if k < 19 else max(0.5, np.percentile(seen, 95)))


def test_numbering_over_ranges(spark):
    ids = spark.range(500).select(F.col("id").alias("household_id")).repartition(7)
    want = sorted(range(500), key=str)
    assert [r.household_id for r in cohort.numbered(ids, F.col("household_id").cast("string")).orderBy("place").collect()] == want
    assert {r.household_id: r.shard for r in cohort.train_slot_shards(ids, 3).collect()} == {h: i % 3 for i, h in enumerate(want)}
    assert cohort.numbered(ids.limit(0), "household_id").count() == 0


def test_dq_counts_of_flags(spark):
    raw = spark.createDataFrame([(1, None), (2, 1.0)], "household_id long, kwh double")
    out = raw.selectExpr("*", "1 as load_missing", "int(household_id = 2) as weather_missing")
    r = prepare.dq_counts({"raw": raw, "out": out}).first()
    assert (r.raw_rows, r.raw_households, r.raw_null_kwh, r.out_load_missing, r.out_weather_missing) == (2, 2, 1, 2, 1) and "raw_load_missing" not in r.asDict()
    assert prepare.dq_ratios(prepare.dq_counts({"raw": raw, "out": out})).first().weather_coverage == 0.5
    assert prepare.dq_counts({"raw": raw.limit(0)}).first().raw_rows == 0


def test_krum_drops_the_outlier_and_checks_its_bound(spark):
    u = vectors(spark, {0: [0, 0.1], 1: [0.1, 0], 2: [0.1, 0.1], 3: [0, 0], 4: [50, 50]})
    d = updates.pairwise_distance(u, chunk=1)
    assert d.where("a = 0 and b = 2").first().distance == pytest.approx(0.01)
    chosen = updates.multi_krum(updates.krum_score(d, 1), 1).collect()
    assert [r.agent_id for r in chosen if not r.accepted] == [4]
    small = updates.pairwise_distance(vectors(spark, {i: [i] for i in range(4)}))
    with pytest.raises(Exception, match="2f \\+ 3"):
        updates.krum_score(small, 1).collect()


def test_means(spark):
    u = vectors(spark, {1: [0], 2: [1], 3: [2], 4: [100]})
    assert updates.trimmed_mean(u, 0.25).first().value == 1.5
    meta = spark.createDataFrame([(0, 1, 1), (0, 2, 100)], "district_id long, agent_id long, n_samples long")
    coords = spark.range(2).select(F.col("id").cast("int").alias("pos"))
    masked = {r.pos: (r.value, r.contributed) for r in updates.masked_weighted_mean(vectors(spark, {1: [8]}), meta, coords).collect()}
    assert masked == {0: (8.0, True), 1: (0.0, False)}
    plain = updates.weighted_mean_update(vectors(spark, {1: [0], 2: [10]}), spark.createDataFrame([(0, 1, 3), (0, 2, 1)], "district_id long, agent_id long, n_samples long"))
    assert plain.first().value == 2.5


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=3, max_size=9))
def test_trimmed_mean_lies_inside(spark, values):
    u = vectors(spark, {i: [x] for i, x in enumerate(values)})
    got = updates.trimmed_mean(u, 0.3).first().value
    assert min(values) - 1e-9 <= got <= max(values) + 1e-9


def test_gate_and_convergence(spark):
    w = spark.createDataFrame([(0, 4.0), (1, 0.0)], "pos int, value double")
    gate = lambda x: updates.relative_update_gate(w, spark.createDataFrame([(0, x)], "pos int, value double")).first()
    assert gate(1.0).accepted and not gate(1.1).accepted
    drift = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 0.1, 0.1, 2.0, 0.1])], "round_id int, drift double")
    got = updates.converged_rounds(drift, 0.5, 2).orderBy("round_id").collect()
    assert [r.stable_rounds for r in got] == [0, 1, 2, 0, 1] and [r.converged for r in got] == [False, False, True, False, False]


def test_noise_is_repeatable_and_absent_at_zero(spark):
    u = vectors(spark, {1: [0.3, 0.4], 2: [0.1, 0.1]})
    show = lambda d: sorted((r.agent_id, r.pos, r.value) for r in d.collect())
    assert show(updates.gaussian_noise(u, 0.0, 9.0)) == show(u)
    assert show(updates.gaussian_noise(u, 1.0, 9.0, 3)) == show(updates.gaussian_noise(u.repartition(5), 1.0, 9.0, 3))


def test_uploads(spark):
    u = spark.createDataFrame([(1, 0, 7, 0, 1.0), (2, 0, 7, 0, 10.0), (3, 0, 8, 1, 2.0), (4, 5, 9, 0, 2.0)], "seq long, district_id long, agent_id long, round_id long, value double")
    assert [(r.agent_id, r.value) for r in updates.upsert_uploads(u).where("round_id = 0").orderBy("agent_id").collect()] == [(7, 10.0), (9, 2.0)]
    rounds = spark.createDataFrame([(0, 1)], "district_id long, round_id long")
    assert [r.status for r in updates.stale_upload_reject(u, rounds).orderBy("seq").collect()] == ["stale", "stale", "accepted", "unknown"]


def test_rounds_run_and_resume(spark, tmp_path):
    w = spark.createDataFrame([(p, 1.0) for p in range(3)], "pos int, value double")
    meta = spark.createDataFrame([(d, 10 * d + a, 2) for d in (0, 1) for a in range(5)], "district_id long, agent_id long, n_samples long")

    def make(now, i):
        return meta.crossJoin(now).select("district_id", "agent_id", "pos", (-0.1 * F.col("value") + 0.001 * (F.col("agent_id") % 10)).alias("value"))

    log = federated.federated_run(w, meta, make, str(tmp_path), 3, 1e-6, 2, federated.RoundConfig(f=1)).orderBy("round_id").collect()
    assert [r.round_id for r in log] == [1, 2, 3] and all(r.accepted for r in log) and log[0].drift > log[2].drift > 0


def test_ledger(spark):
    e = spark.createDataFrame([(1, 2.0, 1.0)] * 5 + [(2, 0.5, 1.0)] * 5 + [(3, 0.0, 1.0)], "agent_id long, sigma double, sample_rate double")
    eps = {r.agent_id: r.epsilon for r in federated.epsilon_ledger(e, 1e-5).collect()}
    assert eps[2] > eps[1] > 0 and eps[3] == 0
    assert eps[1] == pytest.approx(5 * math.sqrt(2 * math.log(1.25 * 5 / 1e-5)) / 2)


# --- sequences, control, memory, evaluation


def test_windows_stay_inside_a_household(spark):
    df = readings(spark, [(h, "W", at(15 * i), float(i)) for h in (1, 2) for i in range(200)])
    assert sequence.sequence_windows(df, 96, 96, ["kwh"]).count() == 18
    split = sequence.temporal_split(df, context=96).groupBy("household_id", "split").count().collect()
    assert {(r.household_id, r.split): r["count"] for r in split if r.household_id == 1} == {(1, "train"): 160, (1, "val"): 116, (1, "test"): 116}


def test_windows_over_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(h, "W", at(15 * i), None if (h, i) == (1, 7) else float(10 * (h or 0) + i)) for h, n in ((1, 23), (2, 3), (3, 9), (None, 8)) for i in range(n)]
    df = readings(spark, rows).withColumn("b", F.col("kwh") * 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.household_id, r.start_ts): (r.end_ts, r.x, r.y) for r in sequence.sequence_windows(df, 4, 2, ["kwh", "b"], 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for h in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == h]
        for i in range(0, len(mine) - 5, 3):
            part = mine[i : i + 6]
            want[h, part[0][2]] = (part[5][2], [[r[3], None if r[3] is None else 2 * r[3]] for r in part[:4]], [r[3] for r in part[4:]])
    assert got == want and len(got) == 6 + 2 + 1


def test_scaler_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = sequence.fit_scaler(df, ["a", "b"])
    assert stats.first().asDict() == {"a_mean": 2.0, "b_mean": 5.0, "a_std": 1.0, "b_std": 1.0}
    scaled = sequence.apply_scaler(df, stats, ["a", "b"])
    assert [tuple(r) for r in scaled.collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [r.a for r in sequence.inverse_scale(scaled, stats, "a").collect()] == [1.0, 3.0]


def test_shedding_takes_the_cheapest_first(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 2.0), (10.0, 8.0), (10.0, 5.0), (10.0, 2.0), (10.0, 0.5)], "predicted double, capacity double")
    got = control.shed_plan(df).collect()
    assert [r.actions for r in got] == [["MONITOR"], ["MAINTAIN"], ["SHED_EV"], ["SHED_EV", "CURTAIL_HVAC"], ["SHED_EV", "CURTAIL_HVAC", "DIM_LIGHTING"], ["CRITICAL_SHED"]]
    assert (got[4].shed_ev, got[4].curtail_hvac) == (3.0, 4.0) and got[4].dim_lighting == pytest.approx(1.0)


def test_drift_flags_come_before_the_update(spark):
    rows = [(1, at(i), i, 1.0) for i in range(10)] + [(1, at(10), 10, 9.0), (2, at(0), 11, 5.0)]
    got = control.drift_flags(spark.createDataFrame(rows, "household_id long, ts timestamp_ntz, event_id long, kwh double"))
    assert {r.event_id for r in got.where("drift").collect()} == {10}


def test_schedule_is_feasible_and_saves(spark):
    rows = [(1, dt.date(2024, 1, 1), s, 1.0) for s in range(96)] + [(2, dt.date(2024, 1, 1), 0, -1.0)]
    plan = control.schedule_job(spark.createDataFrame(rows, "household_id long, day date, slot int, kwh double"))
    good = plan.where("household_id = 1")
    assert {r.status for r in plan.collect()} == {"optimal", "invalid"}
    track = control.soc_trajectory(good, 10.0, 0.95, 0.5)
    assert track.where("not in_bounds or not closed").count() == 0
    assert control.plan_cost(good).first().savings > 0


def grid_cost(load, price, cap, rate, eff, soc0, levels, peak_cap):
    """The least cost of plans whose states of charge are multiples of cap / levels."""
    step, start = cap / levels, round(soc0 * levels)
    cost = {start: 0.0}
    for x, p in zip(load, price, strict=True):
        after = {}
        for a, c in cost.items():
            for b in range(levels + 1):
                move = (b - a) * step
                charge, discharge = max(move, 0) / eff, max(-move, 0) * eff
                net = x + charge - discharge
                if charge <= rate + 1e-9 and discharge <= min(rate, x) + 1e-9 and (peak_cap is None or net <= peak_cap + 1e-9):
                    after[b] = min(after.get(b, math.inf), c + p * net)
        cost = after
    return cost.get(start)


def test_plans_are_exact():
    rng = random.Random(11)
    for k in range(40):
        n = rng.randint(1, 9)
        load = [rng.choice([0.0, rng.random() * 3, 1.0]) for _ in range(n)]
        price = [rng.choice([0.1, 0.2, 0.32, rng.random(), 0.0]) for _ in range(n)]
        cap, rate, eff, soc0 = rng.choice([1.0, 4.0]), rng.choice([0.4, 1.0]), rng.choice([1.0, 0.95, 0.8]), rng.choice([0.0, 0.5, 1.0])
        peak = rng.choice([None, None, 1.4, 2.2])
        status, charge, discharge = control.battery_plan(np.array(load), np.array(price), cap, rate, eff, soc0, peak)
        coarse, fine = (grid_cost(load, price, cap, rate, eff, soc0, m, peak) for m in (20, 200))
        if status == "infeasible":
            assert coarse is None and fine is None
            continue
        soc = soc0 * cap + np.cumsum(eff * charge - discharge / eff)
        assert soc.min() > -1e-6 and soc.max() < cap + 1e-6 and abs(soc[-1] - soc0 * cap) < 1e-6
        assert charge.max() <= rate + 1e-6 and (discharge <= np.minimum(rate, load) + 1e-6).all() and (np.minimum(charge, discharge) < 1e-9).all()
        net = np.array(load) + charge - discharge
        assert peak is None or net.max() <= peak + 1e-6
        cost = float((np.array(price) * net).sum())
        # Never above a grid's plan, and a finer grid comes closer.
        for other in (coarse, fine):
            assert other is None or cost <= other + 1e-6
        if fine is not None and peak is None:
            assert fine - cost <= n * cap / 200 * max(price) * 2
    assert control.battery_plan(np.array([]), np.array([]), 1, 1, 1, 0.5, None)[0] == "empty"
    assert control.battery_plan(np.array([float("nan")]), np.array([1.0]), 1, 1, 1, 0.5, None)[0] == "invalid"
    assert control.battery_plan(np.array([5.0]), np.array([1.0]), 1, 1, 1, 0.5, 3.0)[0] == "infeasible"


def test_runs_hold_back_and_resume(spark, tmp_path):
    rng = random.Random(2)
    w0 = {p: 1.0 + p for p in range(20)}
    own = {(0, a): {p: rng.gauss(0, 1) for p in range(20)} for a in range(5)}
    rows = spark.createDataFrame([(d, a, p, x) for (d, a), vec in own.items() for p, x in vec.items()], "district_id long, agent_id long, pos int, value double")
    meta = rows.select("district_id", "agent_id").distinct().withColumn("n_samples", F.lit(2))

    def make(now, i):  # agent 4 sits the second round out
        part = rows if i != 2 else rows.where("agent_id <> 4")
        return part.join(now.select("pos", F.col("value").alias("old")), "pos").select("district_id", "agent_id", "pos", ((F.col("value") - F.col("old")) / 10).alias("value"))

    config = federated.RoundConfig(clip=1e9, f=0, trim=0.0, limit=10.0)
    w, rest, drifts = dict(w0), {}, []
    for i in (1, 2, 3):
        sent = {}
        for key, vec in own.items():
            if i == 2 and key[1] == 4:
                continue
            total = {p: (vec[p] - w[p]) / 10 + rest.get(key, {}).get(p, 0.0) for p in vec}
            top = sorted(total, key=lambda p: (-abs(total[p]), p))[: max(1, int(len(total) * 0.1))]
            sent[key] = {p: total[p] for p in top}
            rest[key] = {p: x for p, x in total.items() if p not in top}
        new = dict(w)
        for p in w:
            got = [v[p] for v in sent.values() if p in v]
            new[p] += sum(got) / len(got) if got else 0.0
        drifts.append(math.sqrt(sum((new[p] - w[p]) ** 2 for p in w)))
        w = new
    log = federated.federated_run(spark.createDataFrame(list(w0.items()), "pos int, value double"), meta, make, str(tmp_path), 3, 0.0, 9, config, ratio=0.1).orderBy("round_id").collect()
    assert [r.drift for r in log] == pytest.approx(drifts)
    third = spark.read.parquet(f"{tmp_path}/round=3").collect()
    assert {r.pos: r.value for r in third} == pytest.approx(w)
    again = federated.federated_run(None or spark.createDataFrame([(0, 0.0)], "pos int, value double"), meta, make, str(tmp_path), 1, 0.0, 9, config, start=3, ratio=0.1).collect()
    assert [r.drift for r in again] == pytest.approx(drifts[2:])
    assert {r.pos: r.value for r in spark.read.parquet(f"{tmp_path}/round=3").collect()} == pytest.approx(w)


def test_ledger_refuses_unsound_events(spark):
    e = spark.createDataFrame([(1, 2.0, 1.5)], "agent_id long, sigma double, sample_rate double")
    with pytest.raises(ValueError, match="delta"):
        federated.epsilon_ledger(e, 1.0)
    with pytest.raises(Exception, match="sample_rate"):
        federated.epsilon_ledger(e).collect()


def test_districts_without_a_cohort(spark):
    ids = spark.createDataFrame([(h,) for h in ("b", "a", "c", "a10", "a2", "a")], "household_id string")
    got = cohort.alphabetical_cohort(ids, 4, 3).orderBy("rank").collect()
    assert [(r.household_id, r.rank, r.district_id, r.cluster) for r in got] == [("a", 0, "D1", -1), ("a10", 1, "D2", -1), ("a2", 2, "D3", -1), ("b", 3, "D1", -1)]
    with pytest.raises(Exception, match="fewer than 9"):
        cohort.alphabetical_cohort(ids, 9, 3).collect()


def test_blocked_distances_of_many_agents(spark):
    rng = random.Random(6)
    agents = {(d, f"a{i}"): {p: rng.gauss(0, 1) for p in rng.sample(range(9000), 40)} for d in (0, 1) for i in range(150 if d else 3)}
    agents[1, "copy"] = dict(agents[1, "a0"])
    u = spark.createDataFrame([(d, a, p, x) for (d, a), v in agents.items() for p, x in v.items()], "district_id long, agent_id string, pos int, value double")
    got = {(r.district_id, r.a, r.b): r.distance for r in updates.pairwise_distance(u).collect()}
    want = {(d, a, b): sum((x.get(p, 0.0) - y.get(p, 0.0)) ** 2 for p in x.keys() | y.keys()) for (d, a), x in agents.items() for (e, b), y in agents.items() if d == e and a != b}
    assert got == pytest.approx(want, abs=1e-9) and got[1, "a0", "copy"] == 0.0


def test_attention_join_meets_in_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=3).tolist() for i in range(1100)} | {7: None, 8: [1.0, None, 2.0], 9: [1.0, 2.0]}
    rows = spark.createDataFrame([(i % 2, i, x) for i, x in vectors.items()] + [(None, 5000, [1.0, 1.0, 1.0])], "agent_id long, pattern_id long, key array<double>")
    asked = rows.where("pattern_id % 100 in (0, 9) and pattern_id < 5000").select("agent_id", F.col("pattern_id").alias("query_id"), F.col("key").alias("query"))
    joined = memory.attention_join(asked, rows)
    got = {(r.query_id, r.pattern_id): r.logit for r in joined.collect()}
    fits = lambda x, y: x and y and len(x) == len(y) and None not in x and None not in y
    want = {(i, j): float(np.dot(vectors[i], vectors[j])) / math.sqrt(len(vectors[j])) if fits(vectors[i], vectors[j]) else None for i in vectors if i % 100 in (0, 9) for j in vectors if i % 2 == j % 2}
    assert got.keys() == want.keys() and all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "InArrow" in joined._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_large_pool_give_the_best(spark, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK", 16)
    rng = random.Random(7)
    pool = [(a, 100 * a + i, [float(rng.randint(-2, 2)) for _ in range(3)]) for a in (1, 2) for i in range(90)]
    asked = [(a, 1000 * a + i, [float(rng.randint(-2, 2)) for _ in range(3)]) for a in (1, 2, 3) for i in range(40)]
    q = spark.createDataFrame(asked, "agent_id long, query_id long, query array<double>")
    p = spark.createDataFrame([(*r, [float(r[1])]) for r in pool], "agent_id long, pattern_id long, key array<double>, value array<double>")
    got = {(r.query_id, r.place): r.pattern_id for r in memory.attention_best(q, p, 5).collect()}
    want = {}
    for a, i, x in asked:
        best = sorted(((-sum(m * n for m, n in zip(x, y, strict=True)), j) for b, j, y in pool if a == b))[:5]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(best)}
    assert got == want


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(1)
    rows = [(h, rng.expovariate(1.0) if h else float(i)) for h in (0, 1) for i in range(20_000)] + [(1, float("nan")), (1, None)]
    df = spark.createDataFrame(rows, "household_id long, kwh double").withColumn("day", F.pmod(F.xxhash64("kwh"), F.lit(7)))
    days = [prepare.quantile_sketches(df.where(F.col("day") == k)) for k in range(7)]
    grown = days[0]
    for d in days[1:]:
        grown = prepare.merge_sketches(grown, d)
    for r in prepare.sketch_bounds(grown, 0.01, 0.99).collect():
        mine = sorted(x for h, x in rows if h == r.household_id and x is not None and not math.isnan(x))
        for q, x in ((0.01, r.lo), (0.99, r.hi)):
            assert abs(sum(v <= x for v in mine) / len(mine) - q) < 0.002
    assert grown.agg(F.max(F.length("sketch"))).first()[0] < 150_000


def test_intervals_follow_the_residuals(spark):
    f = spark.range(2000).select((F.col("id") % 7).alias("household_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(10.0).alias("yhat"))
    past = spark.range(5000).select(((F.col("id") % 101) / 10 - 5).alias("residual"))
    got = evaluate.predict_intervals(f, past, 20).agg(F.avg("mean"), F.avg("std")).first()
    assert got[0] == pytest.approx(10.0, abs=0.1) and got[1] == pytest.approx(2.9155, abs=0.2)


def test_memory(spark):
    vectors_ = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(6)], "agent_id long, ts long, vector array<double>")
    assert [r.vector for r in memory.pattern_pool(vectors_, 2).orderBy("block").collect()] == [[0.5, 1.0], [2.5, 1.0], [4.5, 1.0]]
    shared = spark.createDataFrame([("k", [1.0] * 4), ("k", [0.0] * 4)], "key string, vector array<double>")
    assert memory.consensus_mean(shared).first().vector == [0.5] * 4
    pool = spark.createDataFrame([(1, i, [float(i == j) for j in range(4)], [10.0 * (i == j) for j in range(4)]) for i in range(4)], "agent_id long, pattern_id long, key array<double>, value array<double>")
    asked = spark.createDataFrame([(1, 5, [1.0, 0.0, 0.0, 0.0])], "agent_id long, query_id long, query array<double>")
    context = memory.attention_topk(asked, pool, 2).first().context
    assert max(range(4), key=context.__getitem__) == 0 and sum(context) == pytest.approx(10)


def test_errors_and_peaks(spark):
    f = spark.createDataFrame([(1.0, 1.5), (3.0, 2.0), (2.0, None)], "y double, yhat double")
    e = evaluate.error_metrics(f).first()
    assert (e.n, e.mae, e.rmse) == (2, 0.75, pytest.approx(math.sqrt(0.625))) and e.r2 == pytest.approx(1 - 1.25 / 2)
    p = evaluate.peak_event_metrics(f, 2.0).first()
    assert (p.tp, p.tn, p.fp, p.fn, p.f1) == (1, 1, 0, 0, 1.0)
    same = spark.createDataFrame([(1, s, x, x, x) for s, x in enumerate([0.1, 0.9])], "window_id long, step int, student double, teacher double, target double")
    k = evaluate.horizon_kl(same).first()
    assert abs(k.kl_loss) < 1e-12 and k.task_loss == 0


def test_local_updates(spark):
    rows = [(1, i, [float(i % 3), 1.0], float(i % 3)) for i in range(40)] + [(2, 0, [1.0], 1.0)]
    got = learn.local_updates(spark.createDataFrame(rows, "agent_id long, seq long, x array<double>, y double"), [0.0, 0.0, 0.0]).collect()
    assert {r.agent_id: r.status for r in got} == {1: "ok", 2: "no_data"}
    again = learn.local_updates(spark.createDataFrame(rows[::-1], "agent_id long, seq long, x array<double>, y double"), [0.0, 0.0, 0.0]).collect()
    assert sorted((r.pos, r.value) for r in got if r.agent_id == 1) == sorted((r.pos, r.value) for r in again if r.agent_id == 1)


def test_local_updates_draw_batches_and_take_a_kernel(spark):
    rows = [(1, i, [float(i)], float(i)) for i in range(500)] + [(2, 0, [1.0], 3.0), (3, 0, None, 1.0)]
    seen = spark.createDataFrame(rows, "agent_id long, seq long, x array<double>, y double")
    got = learn.local_updates(seen, [0.0, 0.0], steps=2, rate=1.0, batch=8, kernel=lambda x, y, w: np.array([-float(len(y)), -1.0])).collect()
    assert {(r.agent_id, r.pos, r.value, r.n_samples, r.status) for r in got} == {(1, 0, 16.0, 500, "ok"), (1, 1, 2.0, 500, "ok"), (2, 0, 2.0, 1, "ok"), (2, 1, 2.0, 1, "ok"), (3, None, None, 0, "no_data")}


def test_intervals_draw_in_batches_and_keep_missing_forecasts(spark):
    f = spark.createDataFrame([(h, at(15 * h), float(h) if h % 3 else None) for h in range(50)], "household_id long, ts timestamp_ntz, yhat double")
    past = spark.createDataFrame([(float(x),) for x in range(-5, 6)], "residual double")
    made = evaluate.predict_intervals(f, past, 7, seed=2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" in plan and "lambdafunction" not in plan
    known = past.agg(F.percentile_approx("residual", [i / 1000 for i in range(1001)], 100100)).first()[0]
    places = {(r[0], k): r[1 + k] for r in f.select("household_id", *[F.pmod(F.xxhash64(F.lit(2), "household_id", "ts", F.lit(k)), F.lit(1001)) for k in range(7)]).collect() for k in range(7)}
    for r in made.collect():
        if r.household_id % 3 == 0:
            assert r.mean is None and r.std is None
            continue
        draws = [r.yhat + known[places[r.household_id, k]] for k in range(7)]
        assert abs(r.mean - np.mean(draws)) < 1e-9 and abs(r.std - np.std(draws)) < 1e-9


def test_learners_and_intervals(spark):
    rng = random.Random(6)
    profile = [(i, *[float(10 * (i % 2) + rng.random()) for _ in range(5)]) for i in range(20)]
    made = learn.cluster_households(spark.createDataFrame(profile, "household_id long, " + ", ".join(f"{c} double" for c in learn.PROFILE)), 2).collect()
    assert len({(r.household_id % 2, r.cluster) for r in made}) == 2
    assert {r.cluster for r in learn.adaptive_k(spark.createDataFrame(profile[:3], "household_id long, " + ", ".join(f"{c} double" for c in learn.PROFILE)), 3).collect()} <= {0, 1}
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(50)], "a double, y double")
    model, out = learn.fit_teacher(rows, ["a"], "y")
    assert out.agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0] < 0.1
    f = spark.createDataFrame([(1, T0, 5.0), (2, T0, 7.0)], "household_id long, ts timestamp, yhat double")
    got = {r.household_id: (r.mean, r.std) for r in evaluate.predict_intervals(f, spark.createDataFrame([(0, 0.5)], "i long, residual double"), 4).collect()}
    assert got == {1: (5.5, 0.0), 2: (7.5, 0.0)}
    assert {r.std for r in evaluate.predict_intervals(f, spark.createDataFrame([], "i long, residual double"), 4).collect()} == {0.0}


# --- reports


def test_round_summaries(spark):
    audit = spark.createDataFrame([(1, 0, 10, True, 3, 2.0, 4.0, 1.0), (1, 0, 11, False, 5, 3.0, 6.0, 1.0)], "district_id long, round_id long, agent_id long, accepted boolean, n_samples long, krum_score double, original_l2 double, clipped_l2 double")
    expected = spark.createDataFrame([(1, 0), (2, 0)], "district_id long, round_id long")
    got = {r.district_id: r for r in report.district_round_summary(audit, {"clip": 1.0}, expected).collect()}
    assert (got[1].acceptance_rate, got[1].n_samples_total, got[1].krum_score_mean, got[1].n_samples_accepted) == (0.5, 8, 2.5, 3)
    assert (got[2].n_agents_total, got[2].acceptance_rate) == (0, 0.0)
    city = report.city_round_summary(spark.createDataFrame([(0, "a", 4, 0.5), (0, "b", 6, float("inf"))], "round_id long, district_id string, n_samples_total long, drift double"), 2).first()
    assert (city.participating_districts, city.n_samples_total, city.drift, city.complete, city.samples_by_district) == (2, 10, 0.5, True, {"a": 4, "b": 6})


def test_bench_report_puts_summaries_together(spark):
    etl = spark.createDataFrame([(100, 4, 80, 3)], "raw_rows long, raw_households long, out_rows long, out_households long")
    p = spark.createDataFrame([("t1", 5, [("first", 0.5), ("last", 0.25)])], "run_id string, n_windows long, stages array<struct<name:string,mae:double>>")
    e = spark.createDataFrame([("t1", 0.25, 0.75, 0.5)], "run_id string, mae double, persistence_mae double, seasonal_mae double")
    a, b = spark.createDataFrame([("s1", 3)], "run_group string, n_rounds long"), spark.createDataFrame([("s2", 60)], "run_group string, n_ticks long")
    got = {(r.section, r.run_group): json.loads(r.body) for r in report.bench_report(etl, training=(p, e), simulation=(a, b)).collect()}
    assert got["etl", None]["rows_retained"] == 0.8 and got["etl", None]["households_retained"] == 0.75
    assert got["training", "t1"] == {"n_windows": 5, "last_stage": "last", "stage_mae": 0.25, "persistence_delta": 0.5, "seasonal_delta": 0.25}
    assert got["simulation", "s1"] == {"n_rounds": 3, "kind": "rounds"} and got["simulation", "s2"] == {"kind": "ticks", "n_ticks": 60}
    with pytest.raises(ValueError, match="no reports"):
        report.bench_report()


def test_rollups(spark):
    counters = spark.createDataFrame([(10, {"MAINTAIN": 9, "SHED_EV": 1}), (12, {"MAINTAIN": 8})], "ticks long, action_counts map<string,long>")
    got = report.building_rollup(counters, ["ticks"]).first()
    assert got.ticks == 22 and got.action_counts == {"MAINTAIN": 17, "SHED_EV": 1}

    def runner(config):
        if config["n"] < 5:
            raise ValueError("too few agents")
        if config["n"] > 9:
            return spark.range(1).select(F.raise_error(F.lit("no such run")).alias("p50"))
        return spark.range(1).select(F.lit(1).alias("p50"))

    got = report.sweep_table(spark, [{"n": 4}, {"n": 8}, {"n": 10}, {"m": 1}], runner).orderBy("i").collect()
    assert [r.status for r in got] == ["failed", "ok", "failed", "failed"] and got[0].error == "ValueError: too few agents" and got[1].figures == {"p50": 1.0} and "no such run" in got[2].error and got[3].error.startswith("KeyError")
    counts = spark.createDataFrame([(480, 12)], "raw_rows long, raw_null_kwh long")
    text = report.dq_report(counts, counts.select((F.col("raw_null_kwh") / F.col("raw_rows")).alias("null_ratio")), spark.createDataFrame([(2, 350)], "n_files long, n_bytes long"))
    assert "null_ratio" in text["json"] and "| n_bytes | 350 |" in text["markdown"]


@pytest.mark.parametrize(("f", "reach"), [(0, 60), (1, 60), (3, 60), (1, 9000)])
def test_krum_without_pairs_equals_krum_of_the_pairs(spark, monkeypatch, f, reach):
    monkeypatch.setattr(updates, "SUMMED", 16)
    rng = random.Random(f)
    agents = {(d, f"a{i}"): {p: rng.gauss(0, 1) for p in rng.sample(range(reach), 20)} for d in (0, 1) for i in range(150 if d else 9)}
    agents[1, "copy"] = dict(agents[1, "a0"])
    agents[0, "far"] = {0: 1e9}
    u = spark.createDataFrame([(d, a, p, x) for (d, a), v in agents.items() for p, x in v.items()], "district_id long, agent_id string, pos int, value double")
    got = {(r.district_id, r.agent_id): r.score for r in updates.krum_scores(u, f).collect()}
    for d in (0, 1):
        mine = [k for k in agents if k[0] == d]
        assert [got[k] for k in mine] == pytest.approx(plain_krum([agents[k] for k in mine], f), rel=1e-9)


def test_krum_without_pairs_checks_its_cohorts(spark):
    u = vectors(spark, {i: [i] for i in range(4)})
    with pytest.raises(Exception, match="2f"):
        updates.krum_scores(u, 1).collect()
    with pytest.raises(ValueError, match="negative"):
        updates.krum_scores(u, -1)
    agents = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "district_id long, agent_id long")
    got = {(r.district_id, r.agent_id): r.score for r in updates.krum_scores(u, 0, agents=agents).collect()}
    assert got[2, 9] == 0.0 and len(got) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 7, 96, 97])
def test_running_maximum_in_two_passes(spark, n):
    rng = random.Random(n)
    x = [(h, i, rng.choice([None, rng.uniform(-9, 9)])) for h in "ab" for i in range(150)]
    out = prepare.running_max(spark.createDataFrame(x, "household_id string, ts long, kwh double"), n)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
    for h in "ab":
        mine = [r[2] for r in x if r[0] == h]
        want = [max((v for v in mine[max(0, i - n + 1) : i + 1] if v is not None), default=None) for i in range(len(mine))]
        assert [r.roll_max for r in out.where(F.col("household_id") == h).orderBy("ts").collect()] == want


def test_bounds_of_the_whole_series_shuffle_rows_once(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("household_id"), F.col("id").alias("ts"), F.rand(1).alias("kwh"))
    bounded = prepare.with_winsor_bounds(rows, 0.01, 0.99)
    assert bounded._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {r.household_id: (r.lo, r.hi) for r in prepare.winsor_bounds(rows, 0.01, 0.99).collect()}
    assert {(r.household_id, r.lo, r.hi) for r in bounded.collect()} == {(h, *b) for h, b in want.items()} and bounded.count() == 2000


def test_gaps_are_filled_in_as_many_parts_as_shuffles_have(spark):
    slots = spark.sql("select id % 40 as household_id, 'w' as weather_id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id div 40) as ts, 1.0D as kwh from range(80)")
    assert prepare.gap_fill(slots).rdd.getNumPartitions() == 4


def test_parts_of_filled_slots_grow_with_the_gaps(spark, monkeypatch):
    # 40 households of two slots, 250 slots apart: 10,040 rows once filled.
    slots = spark.sql("select id % 40 as household_id, 'w' as weather_id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 3750 * (id div 40)) as ts, 1.0D as kwh from range(80)")
    monkeypatch.setattr(prepare, "FILLED", 1000)
    filled = prepare.gap_fill(slots)
    assert prepare.filled_parts(slots) == 11 and filled.count() == 10_040 and filled.rdd.getNumPartitions() == 11
    assert prepare.filled_parts(slots.where("false")) == 0 and prepare.gap_fill(slots.where("false")).count() == 0


def test_sketches_of_parts_come_from_one_reading(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("household_id"), (F.col("id") % 2).alias("half"), F.rand(1).alias("kwh"))
    halves = prepare.quantile_sketches(rows, by=("half",))
    assert halves.count() == 6 and halves._jdf.queryExecution().executedPlan().toString().count("Range") == 1
    one, two = ({r.household_id: (r.lo, r.hi) for r in prepare.sketch_bounds(x).collect()} for x in (prepare.merge_sketches(halves), prepare.merge_sketches(*[prepare.quantile_sketches(rows.where(F.col("half") == k)) for k in (0, 1)])))
    assert one == two and len(one) == 3


def test_capacities_take_filled_slots_where_they_lie(spark):
    slots = spark.sql("select id % 7 as household_id, 'w' as weather_id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 450 * (id div 7)) as ts, id % 13 + 0.5D as kwh from range(210)")
    filled = prepare.causal_impute(prepare.gap_fill(slots.withColumn("household_id", F.when(F.col("household_id") > 0, F.col("household_id")))))
    made = control.adaptive_capacity(filled, days=1, slots=24)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == filled._jdf.queryExecution().executedPlan().toString().count("Exchange")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = {(r.household_id, r.ts): r.capacity for r in made.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sorted(((r.household_id or 0, r.ts, r.kwh) for r in filled.collect()))
    assert len(got) == len(rows)
    for h in range(7):
        mine = [r for r in rows if r[0] == h]
        for i, (_, ts, _) in enumerate(mine):
            want = 1.2 if i < 23 else max(0.5, float(np.quantile([r[2] for r in mine[max(0, i - 23) : i + 1]], 0.95)))
            assert got[h or None, ts] == pytest.approx(want)


def test_a_teacher_is_that_of_all_rows_without_vectors(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(4)
    x = [(rng.gauss(40, 5), rng.random(), rng.randint(0, 1)) for _ in range(500)]
    data = [(a, b, c, 0.5 * a - 3 * b + 2 * c + rng.gauss(0, 1)) for a, b, c in x] + [(None, 1.0, 1, 5.0), (float("nan"), 1.0, 1, 5.0)]
    rows = spark.createDataFrame(data, "a double, b double, c int, y double")
    model, out = learn.fit_teacher(rows, ["a", "b", "c"], "y")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="skip").transform(rows)
    want = LinearRegression(featuresCol="features", labelCol="y", predictionCol="yhat", regParam=1e-3).fit(vectors)
    assert model.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), rel=1e-8) and model.intercept == pytest.approx(want.intercept, rel=1e-8)
    assert sorted(r.yhat for r in out.collect()) == pytest.approx(sorted(r.yhat for r in want.transform(vectors).collect()), rel=1e-8)
    assert out.columns == [*rows.columns, "yhat"] and "UDF" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="targets must not be null"):
        learn.fit_teacher(spark.createDataFrame([(1.0, None), (2.0, 1.0)], "a double, y double"), ["a"], "y")
    with pytest.raises(ValueError, match="no rows"):
        learn.fit_teacher(rows.where("false"), ["a"], "y")


def test_rounding_without_decimals_equals_spark(spark):
    from meterflow.plans import queries

    rng = random.Random(5)
    x = [rng.choice([-1, 1]) * rng.uniform(0, 10.0 ** rng.randint(-8, 13)) for _ in range(20000)] + [k / 800 for k in range(-4000, 4000)] + [None, 0.0, -0.0, float("nan"), float("inf"), -1e-7, 1e-7, 1e300]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    want = df.withColumn("x", F.round(F.col("x") + queries.NUDGE, 6) + 0.0)
    assert [str(r.x) for r in queries.rounded(df).collect()] == [str(r.x) for r in want.collect()]
    assert "rint" in str(queries.rounded(df)._jdf.queryExecution().analyzed()).lower()


def test_a_shed_plan_uses_all_loads_where_they_just_suffice(spark):
    df = spark.createDataFrame([(200.0, 20.0), (200.00000000000003, 20.0), (200.1, 20.0), (20.010000000000002, 20.0)], "predicted double, capacity double")
    got = [r.actions for r in control.shed_plan(df).collect()]
    assert got == [["SHED_EV", "CURTAIL_HVAC", "DIM_LIGHTING"]] * 2 + [["CRITICAL_SHED"], ["MAINTAIN"]]


def test_battery_plans_of_many_days_share_a_task(spark):
    rng = random.Random(9)
    rows = [(h, dt.date(2024, 1, 1) + dt.timedelta(d), s, rng.uniform(0, 3)) for h in range(5) for d in range(9) for s in rng.sample(range(96), rng.randint(1, 96))]
    rows += [(9, dt.date(2024, 1, 1), 0, None), (9, dt.date(2024, 1, 1), 1, 2.0)]
    plan = control.schedule_job(spark.createDataFrame(rows, "household_id long, day date, slot int, kwh double"))
    assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {(r.household_id, r.day, r.slot): (r.status, r.charge, r.discharge) for r in plan.collect()}
    assert len(got) == len(rows) and got[9, dt.date(2024, 1, 1), 1] == ("invalid", 0.0, 0.0)
    for key in {r[:2] for r in rows if r[0] < 9}:
        day = sorted(r[2:] for r in rows if r[:2] == key)
        price = np.array([0.1 if s // 4 < 6 or s // 4 >= 22 else 0.32 if 17 <= s // 4 < 21 else 0.2 for s, _ in day])
        status, charge, discharge = control.battery_plan(np.array([x for _, x in day]), price, 10.0, 2.0, 0.95, 0.5, None)
        for (s, _), c, x in zip(day, charge, discharge, strict=True):
            assert got[*key, s] == (status, pytest.approx(c), pytest.approx(x))


def test_peaks_are_told_at_six_places(spark):
    f = spark.createDataFrame([(40.0 - 7e-15, 40.0), (40.0, 39.99999999999999), (39.9, 41.0), (41.0, 3.0)], "y double, yhat double")
    got = evaluate.peak_event_metrics(f, 40.0).first()
    assert (got.tp, got.tn, got.fp, got.fn) == (2, 0, 1, 1)
    one = spark.createDataFrame([(40.0 - 7e-15, 40.0)], "y double, yhat double")
    assert evaluate.peak_weighted_loss(one, 40.0).first() == evaluate.peak_weighted_loss(one, 30.0).first()


def test_episodes_without_a_reward_are_drawn_last(spark):
    e = spark.createDataFrame([(i, None if i < 5 else 0.1 * i) for i in range(12)], "event_id long, reward double")
    assert {r.event_id for r in cohort.priority_sample(e, 7).collect()} == set(range(5, 12))


def shuffled(spark, df):
    """Bytes that a frame's run writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.mark.parametrize("made", [lambda u: updates.krum_scores(u, 1), updates.pairwise_distance])
def test_blocks_are_packed_before_they_are_shuffled(spark, made):
    """Rows would be shuffled as many times the 4 bytes of a value."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 64)).astype(np.float32))], "district_id long, agent_id long, x array<float>").repartition(2, "agent_id").localCheckpoint()
    u = rows.select("district_id", "agent_id", F.posexplode("x").alias("pos", "value"))
    assert shuffled(spark, made(u)) < 5 * 600 * 64 * 4


def test_packed_blocks_tell_of_each_value(spark, monkeypatch):
    """Values of 8 bytes, agents that send apart and text as keys, packed a few at a time."""
    monkeypatch.setattr(updates, "TILE", 100)
    rng = random.Random(5)
    states = {(d, f"a{i}"): {p: rng.choice([rng.gauss(0, 1), 0.5, float(p)]) for p in range(12) if rng.random() < 0.8} for d in ("x", None, "y") for i in range(90)}
    u = spark.createDataFrame([(d, a, p, x) for (d, a), v in states.items() for p, x in v.items()], "`my district` string, agent_id string, pos int, value double").repartition(7)
    keys = ("my district",)
    got = {(r[0], r.a, r.b): r.distance for r in updates.pairwise_distance(u, keys).collect()}
    want = {(d, a, b): sum((x.get(p, 0.0) - y.get(p, 0.0)) ** 2 for p in range(12)) for (d, a), x in states.items() for (e, b), y in states.items() if d == e and d and a != b}
    assert got == pytest.approx(want, abs=1e-9)
    scores = {(r[0], r.agent_id): r.score for r in updates.krum_scores(u.where("`my district` is not null"), 2, keys).collect()}
    for d in "xy":
        mine = [k for k in states if k[0] == d]
        assert [scores[k] for k in mine] == pytest.approx(plain_krum([states[k] for k in mine], 2), rel=1e-9)


def test_a_round_shuffles_vectors_as_bytes(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(1 + i % 2, i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 64)).astype(np.float32))], "district_id long, agent_id long, x array<float>").repartition(2, "agent_id").localCheckpoint()
    u = rows.select("district_id", "agent_id", F.posexplode("x").alias("pos", "value"))
    deltas, _ = federated.district_deltas(u, rows.select("district_id", "agent_id", F.lit(1).alias("n_samples")), federated.RoundConfig())
    assert shuffled(spark, deltas) < 2 * 600 * 64 * 4


@pytest.mark.parametrize("r", [0.0, 0.1, 0.34, 0.49])
def test_a_trimmed_mean_of_packed_values(spark, r):
    rng = random.Random(7)
    sent = [(d, f"a{i}", p, rng.choice([rng.gauss(0, 1), 0.25])) for d in ("x", "y") for i in range(3 if d == "x" else 40) for p in range(40) if rng.random() < 0.7]
    u = spark.createDataFrame(sent, "district_id string, agent_id string, pos int, value double").repartition(5)
    scaled = u.withColumn("scale", F.crc32("agent_id") % 4 / 4)
    kept = updates.unpacked_agents(updates.packed_agents(u))
    assert sorted(kept.collect()) == sorted((d, a, p, x) for d, a, p, x in sent)
    want = {(d, p): x for d, p, x in updates.trimmed_mean(scaled.withColumn("value", F.col("value") * F.col("scale")), r).collect()}
    assert {(d, p): x for d, p, x in updates.packed_trimmed_mean(scaled, r).collect()} == pytest.approx(want, abs=1e-12)
    far = {(d, a, b): x for d, a, b, x in updates.pairwise_distance(scaled.withColumn("value", F.col("value") * F.col("scale")).drop("scale")).collect()}
    assert {(d, a, b): x for d, a, b, x in updates.pairwise_distance(scaled).collect()} == pytest.approx(far, abs=1e-12)


def odd_slots(spark, seed=4):
    """Slots of households with gaps, nulls, numbers that are not finite, no weather id or no id, and one with two weather ids."""
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf")]
    kwh = lambda: rng.choice(odd) if rng.random() < 0.1 else round(rng.expovariate(0.2), 2)
    rows = [(h, None if h == 5 else f"W{(h or 0) % 3}", at(15 * i), kwh()) for h in [None, *range(12)] for i in range(rng.choice((1, 40, 700))) if rng.random() < 0.3 or not i]
    return readings(spark, rows + [(3, "V", at(15 * i + 15 * 10_000), kwh()) for i in range(0, 300, 3)])


def test_series_are_those_of_windows(spark, monkeypatch):
    monkeypatch.setattr(series, "TOGETHER", 500)
    slots = odd_slots(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        limits = spark.createDataFrame([(h, lo, hi) for h, lo, hi in ((0, 1.0, 9.0), (1, None, 5.0), (2, 3.0, None), (3, -4.0, 6.0), (4, 5.0, 1.0), (5, float("nan"), 4.0), (6, 1.0, float("nan")), (None, 1.0, 2.0), (99, 0.0, 1.0))], "household_id long, lo double, hi double")
        columns = ["kwh", "load_missing", "lag_1", "lag_4", "lag_96", "roll_mean_4", "roll_std_4", "roll_max_96"]
        flagged = prepare.missing_flags(prepare.null_nonfinite(prepare.gap_fill(slots), ["kwh"]), weather=("ts", "ts"))
        want = prepare.rolling_features(prepare.lag_features(prepare.clip_bounds(prepare.quantile_join(prepare.causal_impute(flagged), limits), "kwh", "lo", "hi")))
        told = lambda df: sorted((str(r[0]), str(r[1]), r[2], *(round(x, 9) for x in r[3:])) for r in df.select("household_id", "weather_id", "ts", *columns).collect())
        assert told(series.complete(slots, columns, limits)) == told(want)
        bounds = {r.household_id: (r.lo, r.hi) for r in series.exact_bounds(slots, 0.1, 0.9).collect()}
        assert bounds == {r.household_id: (r.lo, r.hi) for r in prepare.winsor_bounds(prepare.causal_impute(flagged), 0.1, 0.9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quantiles_of_many_parts_meet_in_groups(spark, monkeypatch):
    """Not one task merges a summary of each partition; ranks are near, and exact where there are few values."""
    x = spark.range(0, 3_000_000, 1, 200).select(F.when(F.col("id") % 10 > 0, F.pow(F.rand(1), 3)).alias("residual"))
    points = lambda df: evaluate._quantiles(df.mapInArrow(lambda batches: evaluate._read(b.column(0).drop_null().to_numpy() for b in batches), evaluate.POINT))
    got = points(x)
    assert len(got) == 1001 and np.abs(np.cbrt(got) - np.arange(1001) / 1000).max() < 0.003
    few = spark.createDataFrame([(float(k % 7),) for k in range(100)] + [(None,)], "residual double")
    assert points(few).tolist() == few.agg(F.percentile_approx("residual", [k / 1000 for k in range(1001)], 100100)).first()[0]
    assert len(points(few.limit(0))) == 0


@pytest.mark.parametrize("of", ["long", "string"])
def test_intervals_from_arrays_are_those_of_windows(spark, of):
    """Without a window over filled rows, which six copies of the tables took too long for."""
    slots = odd_slots(spark, 5).withColumn("household_id", F.col("household_id").cast(of)).where("kwh is null or abs(kwh) < 1e9")
    f = sequence.baseline_forecast(prepare.causal_impute(prepare.gap_fill(slots))).where("yhat is not null")
    want = evaluate.predict_intervals(f, f.select((F.col("y") - F.col("yhat")).alias("residual")), seed=3)
    made = evaluate.persistence_intervals(slots, seed=3)
    told = lambda df: sorted(str((r.household_id, r.ts, round(r.yhat, 9), round(r.mean, 9), round(r.std, 9))) for r in df.collect())
    assert made.columns == want.columns and told(made) == told(want)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert evaluate.persistence_intervals(slots.limit(1)).count() == 0


def copies(u):
    """How often the values of updates travel to make their pairs."""
    names = list(updates.COHORT)
    met = updates._met(u, updates._cohorts(u, names, 16), names, 16, updates.PAIRED, updates.SHARES)._df
    return met.agg(F.sum(F.length("value"))).first()[0] / (4 * u.count())


def test_values_of_a_large_cohort_travel_four_times(spark):
    u = spark.range(20_000).select(F.lit(1).alias("district_id"), F.col("id").alias("agent_id"), F.posexplode(F.array(F.lit(0.5), F.col("id") % 8 / 8.0)).alias("pos", "value"))
    assert copies(u) == 4


def test_values_of_a_large_sparse_cohort_travel_four_times(spark):
    u = spark.range(20_000).select(F.lit(1).alias("district_id"), F.col("id").alias("agent_id"), F.posexplode(F.array(*[F.lit(k / 4) for k in range(5)])).alias("pos", "value"))
    assert copies(u.where("(agent_id + pos) % 5 <> 0")) == 4


def test_pairs_leave_some_columns_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(updates, "BESIDE", 7)
    rng = random.Random(6)
    states = {(d, i): [rng.gauss(0, 1) for _ in range(3)] for d, n in ((1, 150), (2, 20), (3, 1)) for i in range(n)}
    u = spark.createDataFrame([(d, i, p, x) for (d, i), v in states.items() for p, x in enumerate(v)], "district_id long, agent_id long, pos int, value double")
    made = updates.pairwise_distance(u).collect()
    want = {(d, a, b): sum((m - n) ** 2 for m, n in zip(x, y, strict=True)) for (d, a), x in states.items() for (e, b), y in states.items() if d == e and a != b}
    assert {(r.district_id, r.a, r.b): r.distance for r in made} == pytest.approx(want, abs=1e-9) and len(made) == len(want)
