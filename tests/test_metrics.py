"""Metrics, range functions, exposition and evidence on small inputs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import evidence, metrics, promql


def test_histogram_counts_and_clamps(spark):
    d = spark.createDataFrame([("a", x) for x in (-1.0, 0.0001, 0.00011, 4.9, 5.0, 6.0)], "op string, s double")
    got = {r["le"]: r["cumulative_count"] for r in metrics.histogram(d, F.col("s"), ("op",)).collect()}
    assert (got["0.0001"], got["0.0005"], got["5"], got["+Inf"]) == (2, 3, 5, 6)


def test_floor_percentile(spark):
    d = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)] + [("b", 7)] + [("c", 5)] * 9 + [("c", 1)], "g string, v bigint")
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in metrics.floor_percentiles(d, "v", ("g",)).collect()}
    assert got == {"a": (2, 3, 3), "b": (7, 7, 7), "c": (5, 5, 5)}


def test_exposition_lines(spark):
    obs = spark.createDataFrame([("put", 2_500_000)] * 3, "operation string, ns bigint")
    h = metrics.histogram(obs, F.col("ns") / 1e9, ("operation",))
    t = metrics.histogram_totals(obs, F.col("ns"), ("operation",))
    lines = [r["line"] for r in metrics.histogram_lines(h, t, "x_seconds", "operation").orderBy("ord").collect()]
    assert lines[0] == 'x_seconds_bucket{operation="put",le="0.0001"} 0'
    assert lines[3] == 'x_seconds_bucket{operation="put",le="0.005"} 3'
    assert lines[-3:] == ['x_seconds_bucket{operation="put",le="+Inf"} 3', 'x_seconds_sum{operation="put"} 0.0075', 'x_seconds_count{operation="put"} 3']
    back = {(r["metric"], r["labels"].get("le")): r["value"] for r in metrics.parse_exposition(spark.createDataFrame([(x,) for x in [*lines, "# TYPE x gauge", ""]], "value string")).collect()}
    assert back[("x_seconds_bucket", "0.005")] == 3 and back[("x_seconds_count", None)] == 3


def test_lag_gauges(spark):
    d = spark.range(1).select(metrics.apply_lag(F.lit(5), F.lit(9)), metrics.peer_lag(F.lit(10), F.lit(5)))
    assert tuple(d.first()) == (0, 5)
    g = spark.createDataFrame([("lag", {"peer": "2", "a": "x"}, 5.0), ("term", {}, 7.0)], "metric string, labels map<string,string>, value double")
    assert sorted(r["line"] for r in metrics.gauge_lines(g, "n_").collect()) == ['n_lag{a="x",peer="2"} 5', "n_term 7"]


def test_quantile(spark):
    d = spark.createDataFrame([("a", 0.1, 10), ("a", 0.5, 20), ("a", float("inf"), 20), ("b", 0.1, 0), ("b", 0.5, 1), ("b", float("inf"), 10), ("c", 0.1, 0), ("c", 0.5, 0), ("c", float("inf"), 0)], "g string, le double, cumulative_count bigint")
    got = {r[0]: r[1] for r in promql.quantile(d, 0.95, ("g",)).collect()}
    assert got["a"] == pytest.approx(0.1 + 0.4 * 9 / 10) and got["b"] == 0.5 and got["c"] is None


def test_sustained_and_rate(spark):
    d = spark.createDataFrame([(t, v) for t, v in ((0, 1), (10, 1), (20, 0), (30, 1), (40, 1), (70, 1))], "ts bigint, v int")
    got = [(r["started"], r["ended"], r["fires_at"]) for r in promql.sustained(d, F.col("v") == 1, 30).collect()]
    assert got == [(30, 70, 70)]
    c = spark.createDataFrame([(0, 5.0), (60, 8.0), (120, 2.0), (600, 4.0)], "ts bigint, value double")
    assert [r["increase"] for r in promql.increases(c, ()).orderBy("ts").collect()] == [None, 3.0, 2.0, 2.0]
    assert [r["rate"] for r in promql.rate(c, ()).orderBy("ts").collect()] == [None, 3 / 300, 5 / 300, None]
    far = spark.createDataFrame([(0, 0.0), (1000, 300.0)], "ts bigint, value double")  # one sample is in range
    assert [r["rate"] for r in promql.rate(far, ()).orderBy("ts").collect()] == [None, None]


def test_alert_rules(spark):
    rows = [(t, "raft_leader", n, "", 0.0 if 100 <= t < 200 else float(n == 1)) for t in range(0, 300, 5) for n in (1, 2)]
    d = spark.createDataFrame(rows, "ts bigint, metric string, node_id bigint, labels_key string, value double")
    assert [tuple(r) for r in promql.alerts(d).collect()] == [("NoLeader", 100, 195, 130)]


STATUS = """node: 2
role: leader
term: 4
leader: unknown
last-log-index: 9
commit-index: 9
last-applied: 8
apply-lag: 1
snapshot-index: 0
snapshot-term: 0
membership: stable
voters:
  3 127.0.0.1:7003
  1 127.0.0.1:7001
"""


def test_status_text(spark):
    r = evidence.parse_status(spark.createDataFrame([(STATUS,)], "value string")).first()
    assert (r["node"], r["role"], r["leader"], r["apply_lag"], r["voters"]) == (2, "leader", None, 1, [1, 3])


def bundle(root, missing=0):
    node = lambda i, role: {"reachable": True, "node": i, "role": role, "term": 2, "apply_lag": 0, "membership": "stable", "voters": [1, 2, 3], "commit_index": 5, "last_applied": 5}
    files = {
        "manifest.json": {"schema_version": 1, "scenario": "leader_failover_under_load", "cluster": {"nodes": 3, "transport": "tcp", "persistence": "disk"}, "workload": {"workers": 16, "put_percent": 70, "get_percent": 30}, "failure": {"method": "SIGKILL", "leader_id": 1}, "recovery": {"replacement_leader_id": 2, "restarted_node_id": 1, "same_data_directory": True}, "result": {"verified_acknowledged_writes": 9}},
        "workload-summary.json": {"acknowledged_before": 4, "acknowledged_after": 5, "stale_requests": 0, "request_conflicts": 0, "unexpected_protocol_errors": 0},
        "acknowledged-writes-summary.json": {"total_acknowledged": 9, "verified_acknowledged": 9 - missing, "verification_missing": missing},
        "timeline.json": [{"event": e, "at_seconds": 0.1} for e in evidence.REQUIRED_EVENTS],
        "initial-status.json": {"1": node(1, "leader"), "2": node(2, "follower"), "3": node(3, "follower")},
        "failover-status.json": {"1": {"reachable": False}, "2": node(2, "leader"), "3": node(3, "follower")},
        "final-status.json": {"1": node(1, "follower"), "2": node(2, "leader"), "3": node(3, "follower")},
    }
    for name, content in files.items():
        (root / name).write_text(json.dumps(content, indent=1))
    (root / "SHA256SUMS").write_text("".join(f"{hashlib.sha256((root / n).read_bytes()).hexdigest()}  {n}\n" for n in sorted(files)))


def test_bundle(spark, tmp_path):
    root = tmp_path / "evidence"
    root.mkdir()
    bundle(root)
    got = {r["check"]: r["passed"] for r in evidence.bundle_checks(spark, f"file://{root}").collect()}
    assert len(got) == 20 and all(got.values()), got
    bundle(root, missing=1)
    (root / "timeline.json").write_text("[]")
    bad = {r["check"] for r in evidence.bundle_checks(spark, f"file://{root}").collect() if not r["passed"]}
    assert bad == {"all_verified", "manifest_agrees", "required_events", "checksums"}


def test_acknowledged_writes(spark):
    acks = spark.createDataFrame([("a", "1", "before"), ("b", "2", "after"), ("c", "3", "after")], "key string, value string, phase string")
    final = spark.createDataFrame([("a", "1"), ("b", "9")], "key string, value string")
    assert tuple(evidence.verification(acks, final).first()) == (3, 1, 2)


def test_relevant_log(spark):
    lines = [(1, i, f'{{"event":"{e}","dir":"/x/{i}"}}') for i, e in enumerate(["node_started", "other", "leader_elected"] + ["dedup_stale"] * 200)]
    got = evidence.relevant_log(spark.createDataFrame(lines, "node_id bigint, line_no bigint, value string"), {"/x": "data"})
    assert got.count() == 120 and got.filter("value like '%/x%'").count() == 0


@pytest.mark.parametrize("block", [300, 1000, 10**9])
def test_blocks_change_nothing(spark, block):
    """Rates, increases, counts in range, running sums and runs are the same however a series is cut."""
    r = random.Random(6)
    ts = sorted(r.sample(range(20_000), 400))
    rows = [(g, t, float(r.randrange(50)), r.choice((1, -1))) for g in ("a", None) for t in ts]
    d = spark.createDataFrame(rows, "g string, ts bigint, value double, delta int")
    one = 10**9
    key = lambda x: tuple((v is not None, v) for v in x)
    same = lambda f, *cols: sorted(map(tuple, f(block).select(*cols).collect()), key=key) == sorted(map(tuple, f(one).select(*cols).collect()), key=key)
    assert same(lambda b: promql.increases(d, ("g",), block=b), "g", "ts", "increase")
    assert same(lambda b: promql.rate(d, ("g",), block=b), "g", "ts", "rate")
    assert same(lambda b: promql.event_rate(d, ("g",), "ts", block=b), "g", "ts", "events_in_range")
    assert same(lambda b: promql.sustained(d, F.col("value") > 20, 100, ("g",), block=b), "g", "started", "ended", "fires_at")
    assert same(lambda b: metrics.in_flight(d, ("g",), width=float(b)), "g", "ts", "in_flight")
    assert same(lambda b: metrics.high_water(d, ("g",), width=float(b)), "g", "high_water")
    assert same(lambda b: metrics.floor_percentiles(d, "value", ("g",), width=b / 100), "g", "n", "p50", "p95", "p99")
