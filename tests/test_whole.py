"""Operators with boundaries in the log, on events on both sides of them; every row takes part."""

import pytest

from tests.oracle import differences, duck
from tidelog.operators import log_ops
from tidelog.plans import oracles, workloads

WHOLE = ("jn3_first_conflict", "se5_conflict_repair", "jn5_range_equality", "jn9_waiters", "wn1_assigned_indexes", "se1_union_peers", "jn13_target_changes", "jn2_ack_verification", "jn2_verified_writes", "ag23_ack_phases")


@pytest.mark.parametrize("name", WHOLE)
def test_same_rows_as_sql_where_the_parts_end(spark, name):
    d = "/root/testdata/sf0.01"
    assert differences(workloads.queries()[name], oracles.SQL[name], spark, d, duck(d)) is None


def test_every_row_takes_part(spark, small):
    n, run = spark.read.parquet(f"{small}/events.parquet"), workloads.queries()
    puts = n.filter("event_type <> 'error'").count()
    for name, want in {"wn1_assigned_indexes": n.count(), "jn9_waiters": n.count(), "se5_conflict_repair": n.count(), "jn2_verified_writes": puts}.items():
        assert run[name](spark, small).count() == want
    assert run["jn2_ack_verification"](spark, small).first()["total_acknowledged"] == puts
    assert sum(r["acknowledged"] for r in run["ag23_ack_phases"](spark, small).collect()) == puts


def test_a_late_difference_is_met(spark, small):
    got = {r["pair"]: r["same"] for r in workloads.queries()["jn5_range_equality"](spark, small).collect()}
    assert got == {"equal": True, "shorter": False, "changed": False}


def test_assigned_over_many_blocks(spark):
    kept = [i for i in range(-50, 900) if i % 3]
    d = spark.createDataFrame([(i,) for i in [None, *kept[::-1]]], "arrival bigint").repartition(5)
    got = {r["arrival"]: r["log_index"] for r in log_ops.assigned(d, 10, 1, block=64).collect()}
    assert got == {a: 11 + i for i, a in enumerate([None, *kept])}
