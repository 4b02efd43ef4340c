"""Rows of one time go by their exact time and number, wherever they are stored."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.operators import promql
from tidelog.plans import registry

DAY = datetime.datetime(2024, 1, 1)


def _stored(path, rows, order):
    """Events (event_id, seconds, user_id, event_type, value) in a folder of the testdata form, stored in an order."""
    c = duckdb.connect()
    c.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    c.executemany("insert into e values (?, ?, ?, ?, ?, '{}')", [(i, None if at is None else DAY + datetime.timedelta(seconds=at), u, kind, v) for i, at, u, kind, v in rows])
    c.execute(f"copy (select * from e order by {order}) to '{path}/events.parquet' (format parquet)")
    return c, str(path)


def _alert_events():
    hot = [
        # Off and on again within a second: a run starts at 10,000.
        [(0, 1), (10_000.2, 0), (10_000.7, 1), (35_000, 1)],
        # On and off again: the run goes on from 0 to 30,000 and ends there.
        [(0, 1), (30_000.1, 1), (30_000.6, 0), (60_000, 1)],
        # The last second of a block holds both; the sample of the next block follows the later one.
        [(80_000, 1), (86_399.1, 0), (86_399.9, 1), (86_400, 1), (107_000, 1)],
        [(80_000, 1), (86_399.1, 1), (86_399.9, 0), (86_400, 1), (107_000, 1)],
        # Equal times go by number.
        [(0, 1), (25_000, 1), (25_000, 0), (25_000, 1), (50_000, 1)],
    ]
    rows = [(at, user, 30.0 if on else 1.0) for user, series in enumerate(hot) for at, on in series]
    return [(i, at, user, "view", v) for i, (at, user, v) in enumerate(rows)]


@pytest.mark.parametrize("order", ["event_id", "event_id desc", "hash(event_id)"])
def test_alerts_in_one_second(spark, tmp_path, order):
    c, d = _stored(tmp_path, _alert_events(), order)
    sql = registry.oracle_sql()["wn11_sustained_alert"]
    settled = sql.replace("select user_id, cast(", "select user_id, ts as exact, event_id, cast(").replace("order by ts", "order by ts, exact, event_id")
    assert settled.count("exact, event_id") == 3
    got = sorted(tuple(r) for r in registry.queries()["wn11_sustained_alert"](spark, d).collect())
    want = [(0, 10_000, 35_000, 35_000), (1, 0, 30_000, 30_000), (2, 86_399, 107_000, 107_000), (3, 86_400, 107_000, 107_000), (4, 0, 25_000, 25_000), (4, 25_000, 50_000, 50_000)]
    midnight = int(DAY.replace(tzinfo=datetime.timezone.utc).timestamp())
    assert [(u, *(t - midnight for t in times)) for u, *times in got] == want
    c.execute(settled.replace("from events", "from e"))
    assert got == sorted(c.fetchall())


@pytest.mark.parametrize("block", [7, 1000])
def test_runs_of_one_second_are_apart(spark, block):
    d = spark.createDataFrame([(5, n, n % 2) for n in (3, 2, 1, 0)] + [(None, 9, 1), (6, 4, 1)], "ts bigint, n bigint, v int")
    got = promql.sustained(d, F.col("v") == 1, 0, block=block, ties=("n",)).collect()
    assert sorted(tuple(r) for r in got) == [(5, 5, 5), (5, 6, 5)]


@pytest.mark.parametrize("order", ["event_id", "event_id desc"])
@pytest.mark.parametrize("kinds", [("view", "click", "error", "signup", "purchase"), ("purchase", "signup", "error", "click", "view")])
def test_checkpoints_in_one_second(spark, tmp_path, order, kinds):
    times = (5.1, 7.2, 7.2, 7.8, 7.9)
    late = [(10 + i, 7.95 + i, 1, kind, 1.0) for i, kind in enumerate(kinds)]
    c, d = _stored(tmp_path, [*((i, times[i], 1, kind, 1.0) for i, kind in enumerate(kinds)), *late, (20, None, 1, kinds[4], 1.0)], order)
    got = {r["event_type"]: (r["ordinal"], r["mode"], r["checkpoint"]) for r in registry.queries()["wn8_checkpoints"](spark, d).collect()}
    modes = [("initial", "initial"), ("initial", "initial"), ("crash", None), ("failover", "failover"), ("failover", "failover")]
    assert got == {kind: (i, *modes[i]) for i, kind in enumerate(kinds)}
    sql = registry.oracle_sql()["wn8_checkpoints"]
    settled = sql.replace(" as at_seconds from events", " as at_seconds, min((ts, event_id)) filter (where ts is not null) as first from e").replace("order by at_seconds", "order by at_seconds, first")
    assert settled.count(" first") == 2
    c.execute(f"select event_type, ordinal, mode, checkpoint from ({settled})")
    assert got == {kind: tuple(rest) for kind, *rest in c.fetchall()}
