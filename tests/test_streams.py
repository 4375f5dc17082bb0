"""Streaming queries over awkward event tables against their SQL."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from alertloom.plans import load

QUERIES, ORACLES = load()
START = datetime.datetime(2024, 1, 1)
#: Seconds after the start, per user: gaps of just under, of just, and of just over 12 hours, in whole seconds and in fractions.
TIMES = {
    1: [0.9, 43_200.5, 86_399.4],
    2: [0.1, 43_199.9, 86_400.2],
    3: [5.0, 43_205.0, 86_404.0],
    4: [7.999999, 43_208.0, 86_407.000001],
}


@pytest.mark.parametrize("as_folder", [False, True])
@pytest.mark.parametrize("name", ["stream_sessions", "stream_fixed_windows"])
def test_stream_equals_sql_at_the_gap(spark, tmp_path, name, as_folder):
    rows = [(u, START + datetime.timedelta(seconds=s), "error" if k == 1 else "click") for u, times in TIMES.items() for k, s in enumerate(times)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, 1.0, '{}')", [(i, t, u, kind) for i, (u, t, kind) in enumerate(rows)])
    target = tmp_path / "events.parquet"
    if as_folder:
        target.mkdir()
        for i in (0, 1):
            con.execute(f"COPY (SELECT * FROM events WHERE event_id % 2 = {i}) TO '{target}/part-{i}.parquet'")
    else:
        con.execute(f"COPY events TO '{target}'")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())
