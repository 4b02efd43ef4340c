"""State, dedup and log operators against small scenarios and random logs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import log_ops, state
from tidelog.plans import events as ev

LOG = "log_index bigint, client_id bigint, seq bigint, k string, op string, v string, fp string"


def log(spark, rows):
    """Rows (client, seq, key, value) in order; a value of None deletes."""
    return spark.createDataFrame([(i + 1, c, s, k, "DELETE" if v is None else "PUT", v, f"{k}={v}") for i, (c, s, k, v) in enumerate(rows)], LOG)


SCENARIOS = {
    "first": ([(1, 1, "x", "1")], ["NEW"], {"x": "1"}),
    "duplicate": ([(1, 1, "x", "1"), (None, None, "x", "other"), (1, 1, "x", "1")], ["NEW", "NEW", "DUPLICATE"], {"x": "other"}),
    "conflict": ([(1, 1, "x", "1"), (1, 1, "x", "2")], ["NEW", "CONFLICT"], {"x": "1"}),
    "stale": ([(1, 1, "x", "1"), (1, 2, "x", "2"), (1, 1, "x", "1")], ["NEW", "NEW", "STALE"], {"x": "2"}),
    "gap": ([(1, 1, "x", "1"), (1, 3, "x", "3"), (1, 2, "x", "2"), (1, 3, "x", "3")], ["NEW", "STALE", "NEW", "NEW"], {"x": "3"}),
    "unidentified": ([(None, None, "x", "1"), (None, None, "x", "1")], ["NEW", "NEW"], {"x": "1"}),
    "independent": ([(1, 1, "x", "1"), (2, 1, "y", "1"), (2, 1, "y", "1")], ["NEW", "NEW", "DUPLICATE"], {"x": "1", "y": "1"}),
    "no wedge": ([(1, 1, "x", "1"), (1, 1, "x", "2"), (1, 2, "y", "2")], ["NEW", "CONFLICT", "NEW"], {"x": "1", "y": "2"}),
    "empty value": ([(1, 1, "x", ""), (1, 2, "y", None)], ["NEW", "NEW"], {"x": ""}),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    rows, outcomes, final = SCENARIOS[name]
    d = log(spark, rows)
    assert [r["outcome"] for r in state.classify(d).orderBy("log_index").collect()] == outcomes
    assert {r["k"]: r["v"] for r in state.identified_state(d).collect()} == final


def test_random_logs(spark):
    r = random.Random(3)
    rows = [(r.randrange(5), r.randrange(1, 30), r.choice("abc"), r.choice([None, "1", "2"])) for _ in range(1500)]
    rows = [(c, s, k, v) for i in range(3) for c, s, k, v in sorted(rows[i * 500 : i * 500 + 500], key=lambda x: x[1] + r.randrange(3))]
    last, kv, want = {}, {}, []
    for c, s, k, v in rows:
        n, f = last.get(c, (0, None))
        got = ("DUPLICATE" if f == (k, v) else "CONFLICT") if s == n else "NEW" if s == n + 1 else "STALE"
        want.append(got)
        if got == "NEW":
            last[c] = (s, (k, v))
            kv[k] = v
    d = log(spark, rows)
    assert set(want) == {"NEW", "DUPLICATE", "CONFLICT", "STALE"}
    assert [x["outcome"] for x in state.classify(d).orderBy("log_index").collect()] == want
    assert {x["k"]: x["v"] for x in state.identified_state(d).collect()} == {k: v for k, v in kv.items() if v is not None}
    assert {x["client_id"]: x["last_seq"] for x in state.client_records(d).collect()} == {c: s for c, (s, _) in last.items()}


def test_empty_log(spark):
    d = log(spark, [])
    assert state.identified_state(d).count() == 0
    assert state.live(d).count() == 0
    assert log_ops.bounds(d.withColumn("term", F.lit(1))).first()["last_index"] == 0


def test_snapshot_and_suffix_equal_the_whole(spark, small):
    d = ev.clean_log(ev.events(spark, small))
    whole = sorted(map(tuple, state.live(d).select("k", "v").collect()))
    for at in (0, 1, 500, 999, 5000):
        assert sorted(map(tuple, state.restored(state.snapshot(d, at), d, at).select("k", "v").collect())) == whole


ENTRIES = "log_index bigint, term bigint, kind int, command binary"


def entries(spark, rows):
    return spark.createDataFrame([(i, t, 0, c) for i, t, c in rows], ENTRIES)


def test_range_is_bounded_by_bytes_but_never_empty(spark):
    d = entries(spark, [(i, 1, b"0123456789") for i in range(1, 6)])
    at = lambda *a: [r[0] for r in log_ops.entries_range(d, *a).orderBy("log_index").select("log_index").collect()]
    assert at(1, 100, 50) == [1, 2]
    assert at(3, 2, 10_000) == [3, 4]
    assert at(4, 10, 1) == [4]
    assert at(9, 10, 100) == []


def test_repair(spark):
    local = entries(spark, [(1, 1, b"a"), (2, 1, b"b"), (3, 2, b"c"), (4, 2, b"d")])
    new = entries(spark, [(2, 1, b"b"), (3, 3, b"x")])
    assert log_ops.first_conflict(new, local).first()[0] == 3
    assert sorted((r[0], r[1], bytes(r[3])) for r in log_ops.repaired(local, new).collect()) == [(1, 1, b"a"), (2, 1, b"b"), (3, 3, b"x")]
    old = entries(spark, [(2, 1, b"b")])
    assert log_ops.repaired(local, old).count() == 4
    assert log_ops.first_conflict(old, local).first()[0] is None


def test_boundaries(spark):
    d = entries(spark, [(5, 2, b"a"), (6, 2, b"b"), (7, 3, b"c")])
    assert sorted(r[0] for r in log_ops.compacted(d, 6, 4).collect()) == [7]
    assert log_ops.compacted(d, 3, 4).count() == 3
    with pytest.raises(Exception, match="behind"):
        log_ops.compacted(d, 9, 4).collect()
    assert [r[0] for r in log_ops.installed(d, 6, 2).collect()] == [7]
    assert log_ops.installed(d, 6, 3).count() == 0
    wanted = spark.createDataFrame([(3,), (4,), (5,), (7,), (9,)], "log_index bigint")
    assert [r["term"] for r in log_ops.term_at(d, wanted, 4, 1).orderBy("log_index").collect()] == [None, 1, 2, 3, None]
    assert log_ops.prev_matches(d, 4, 1, 4, 1).first()[0]
    assert not log_ops.prev_matches(d, 7, 2, 4, 1).first()[0]


def test_gaps(spark):
    s = spark.createDataFrame([(1, 4), (5, 2), (8, 3), (10, 1)], "start_index bigint, entries bigint")
    assert sorted(r[0] for r in log_ops.gaps(s).collect()) == [8, 10]


def test_one_client_with_very_many_rows(spark):
    n = 400_000
    d = spark.range(1, n + 1).select(F.col("id").alias("log_index"), F.lit(7).cast("bigint").alias("client_id"), F.when(F.col("id") % 1000 == 0, F.col("id") - 1).otherwise(F.col("id") - F.floor(F.col("id") / 1000)).alias("seq"), F.lit("k").alias("k"), F.lit("PUT").alias("op"), F.col("id").alias("v"), F.lit("f").alias("fp"))
    began = time.time()
    got = {r[0]: r[1] for r in state.classify(d).groupBy("outcome").count().collect()}
    assert time.time() - began < 30
    assert got["NEW"] > 0 and sum(got.values()) == n


def test_zero_client_bytes_are_unidentified(spark):
    rows = [(1, b"\0" * 16, 5, "a"), (2, b"\1" * 16, 1, "b"), (3, b"\0" * 16, 5, "a"), (4, None, None, "c")]
    d = spark.createDataFrame(rows, "log_index bigint, client_id binary, seq bigint, fp string")
    assert [r["outcome"] for r in state.classify(d).orderBy("log_index").collect()] == ["NEW"] * 4


def test_batches_close_by_entries_and_bytes():
    r = random.Random(5)
    for _ in range(200):
        sizes = [r.choice((1, 3, 5, 20, 60)) for _ in range(r.randrange(1, 40))]
        most, limit = r.randrange(1, 6), r.randrange(5, 50)
        want, batch, n, total = [], 0, 0, 0
        for x in sizes:
            if n and (n >= most or total + x > limit):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + x
            want.append(batch)
        cut, out = r.randrange(len(sizes) + 1), np.zeros(len(sizes), np.int64)
        was = state.close_batches(np.array(sizes[:cut], np.int64), out[:cut], (0, 0, 0), most, limit)
        state.close_batches(np.array(sizes[cut:], np.int64), out[cut:], was, most, limit)
        assert out.tolist() == want
