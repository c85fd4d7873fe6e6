"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from meterflow.plans.stream_queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in ("events", "embeddings", "orders", "lineitem"):
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(([r[i] if isinstance(r[i], float) else str(r[i]) for i in order] for r in rows), key=lambda r: [str(round(x, 3) + 0.0) if isinstance(x, float) else x for x in r])


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns, got = plain(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    names, want = plain([x[0] for x in result.description], result.fetchall())
    assert columns == names
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_runs(spark, name):
    df = queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_draws_that_are_equal_at_six_places_go_by_id(spark, tmp_path):
    """As SQL ranks them; rows without an id or a value, too."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    value = "case when i % 17 = 0 then null when i % 13 = 0 then 'nan'::double else 50 + 1e9 * (1 + i % 7) end"
    con.execute(f"copy (select case when i % 50 <> 7 then 5000 - i end as event_id, timestamp '2024-01-01' + interval 1 minute * i as ts, i % 5 as user_id, 'view' as event_type, {value} as value, '{{}}' as props from range(900) t(i)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in queries()["priority_sample"](spark, str(tmp_path)).collect()]
    assert got == con.execute(SQL["priority_sample"]).fetchall() and len(got) == 200
