"""Queries of metrics over time: rates, alerts, running sums, timelines, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, metrics, promql
from .oracles import _EPOCH, _OBS
from .protocol import e_, u_, _events, registering
from .workloads import _observations

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registering(QUERIES, SQL)


def _scrapes(s: SparkSession, d: str) -> DataFrame:
    """A counter of ten nodes, scraped where something happened: the largest number of a minute's events, reset every 1000."""
    e = _events(s, d).select((u_() % 10).alias("node_id"), (F.floor(promql.epoch("ts") / 60) * 60).alias("ts"), (e_() % 1000).alias("value"))
    return e.groupBy("node_id", "ts").agg(F.max("value").alias("value"))


_SCRAPES = f"c as (select user_id % 10 as node_id, {_EPOCH} // 60 * 60 as ts, max(event_id % 1000) as value from events group by 1, 2)"


def _rate_sql(source: str, by: str, name: str, seconds: int, value: str = "value") -> str:
    """CTEs that add `rate` to a source; the increase from a sample before the range is taken off."""
    return f"""{name}_u as (select *, coalesce(case when lag({value}) over p is null then null when {value} < lag({value}) over p then {value} else {value} - lag({value}) over p end, 0) as up from {source} window p as (partition by {by} order by ts)),
{name} as (select *, case when count(*) over r > 1 then (sum(up) over r - first_value(up) over r) / {seconds} end as rate from {name}_u window r as (partition by {by} order by ts range between {seconds - 1} preceding and current row))"""


@query(f"with {_SCRAPES}, {_rate_sql('c', 'node_id', 'r', 21600)} select node_id, ts, round(rate, 9) as rate from r")
def wn9_rate_6h(s, d):
    """The range is six hours, as events are minutes to hours apart; the operator and its edges are those of five minutes."""
    return promql.rate(_scrapes(s, d), ("node_id",), seconds=21_600).select("node_id", "ts", F.round("rate", 9).alias("rate"))


@query(f"with {_SCRAPES}, {_rate_sql('c', 'node_id', 'r', 300)} select node_id, ts, round(rate, 9) as rate from r")
def wn9_rate_5m(s, d):
    return promql.rate(_scrapes(s, d), ("node_id",)).select("node_id", "ts", F.round("rate", 9).alias("rate"))


@query(f"with e as (select event_id, event_type, {_EPOCH} as sec from events) select event_id, event_type, count(*) over (partition by event_type order by sec range between 300 preceding and current row) as events_in_range from e")
def wn12_events_in_range(s, d):
    e = _events(s, d).select("event_id", "event_type", promql.epoch("ts").alias("at"))
    return promql.event_rate(e, ("event_type",), "at", 300).select("event_id", "event_type", "events_in_range")


#: Metrics of the alert rules with the value that an event gives them.
_VALUES: dict[str, tuple[Callable[[], Column], str]] = {
    "raft_leader": (lambda: F.when(F.col("event_type") == "purchase", 1).otherwise(0), "(event_type = 'purchase')::int"),
    "raft_leadership_changes_total": (lambda: e_() % 5000, "event_id % 5000"),
    "raft_peer_replication_lag": (lambda: e_() % 4000, "event_id % 4000"),
    "raft_apply_lag": (lambda: e_() % 300, "event_id % 300"),
    "requests_busy_total": (lambda: e_() * 700, "event_id * 700"),
    "transport_connections_dialed_total": (lambda: e_() * 3000, "event_id * 3000"),
    "transport_waiters": (lambda: e_() % 3, "event_id % 3"),
    "up": (lambda: F.when(e_() % 5 == 0, 0).otherwise(1), "(event_id % 5 <> 0)::int"),
}
_BUCKETS = (("0.1", 1), ("0.5", 2), ("1", 4), ("+Inf", 5))
_LATENCY = {"request_duration_seconds_bucket": "operation", "persistence_duration_seconds_bucket": "domain"}
#: Half a minute of the log's time is one second of the scrapes', so that ranges of minutes hold several samples.
_SLOW = 30


def _alert_scrapes(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select((F.floor(promql.epoch("ts") / _SLOW / 60) * 60).alias("ts"), (u_() % 2).alias("node_id"), e_(), F.col("event_type"))
    one = [F.struct(F.lit(m).alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), F.lit("").alias("labels_key"), v().cast("double").alias("value")) for m, (v, _) in _VALUES.items()]
    many = [
        F.struct(F.lit(m).alias("metric"), F.create_map(F.lit(label), F.lit("a"), F.lit("le"), F.lit(le)).alias("labels"), F.lit(f"a,{le}").alias("labels_key"), (e_() * n).cast("double").alias("value"))
        for m, label in _LATENCY.items()
        for le, n in _BUCKETS
    ]
    flat = e.select("ts", "node_id", F.explode(F.array(*one, *many)).alias("x")).select("ts", "node_id", "x.metric", "x.labels", "x.labels_key", "x.value")
    return flat.groupBy("ts", "node_id", "metric", "labels_key").agg(F.first("labels").alias("labels"), F.max("value").alias("value"))


def _sustained_sql(now: str, name: str, hold: str, seconds: int, by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    also = f"{by}, " if by else ""
    return f"""{name}_l as (select *, coalesce({hold}, false) as hot, lag(coalesce({hold}, false), 1, false) over ({part}order by ts) as was from {now}),
{name}_r as (select *, sum(case when hot and not was then 1 else 0 end) over ({part}order by ts rows unbounded preceding) as run from {name}_l),
{name}_a as (select *, min(ts) over (partition by {also}run) as since from {name}_r where hot),
{name} as (select min(since) as started, max(ts) as ended, min(ts) filter (where ts - since >= {seconds}) as fires_at from {name}_a group by {also}run having min(ts) filter (where ts - since >= {seconds}) is not null)"""


def _alerts_sql() -> str:
    """All ten rules, a chain of CTEs each."""
    ts = f"cast(floor({_EPOCH} / {_SLOW} / 60) * 60 as bigint)"
    ctes, out = [], []
    for i, (name, (metric, how, op, least, seconds, rated)) in enumerate(promql.RULES.items()):
        ctes.append(f"s{i} as (select {ts} as ts, user_id % 2 as node_id, cast(max({_VALUES[metric][1]}) as double) as value from events group by 1, 2)")
        if rated:
            ctes.append(_rate_sql(f"s{i}", "node_id", f"q{i}", 300))
            ctes.append(f"n{i} as (select ts, {how}(rate) as value from q{i} where rate is not null group by 1)")
        else:
            ctes.append(f"n{i} as (select ts, {how}(value) as value from s{i} group by 1)")
        ctes.append(_sustained_sql(f"n{i}", f"f{i}", f"value {op} {least}", seconds))
        out.append(f"select '{name}' as alert, * from f{i}")
    for i, (name, (metric, label, q, least, seconds)) in enumerate(promql.LATENCY_RULES.items()):
        rows = ", ".join(f"('{le}', {'1e300' if le == '+Inf' else le}, {n}, {j})" for j, (le, n) in enumerate(_BUCKETS))
        ctes.append(f"bs{i} as (select {ts} as ts, user_id % 2 as node_id, le, bound, cast(max(event_id * n) as double) as value from events cross join (values {rows}) b(le, bound, n, j) group by 1, 2, 3, 4)")
        ctes.append(_rate_sql(f"bs{i}", "node_id, le", f"bq{i}", 300))
        ctes.append(f"bc{i} as (select ts, le, bound, sum(rate) as c from bq{i} where rate is not null group by 1, 2, 3)")
        ctes.append(f"bh{i} as (select *, lag(bound, 1, 0) over w as low, lag(c, 1, 0) over w as below, {q} * max(c) over (partition by ts) as rank, max(c) over (partition by ts) as total from bc{i} window w as (partition by ts order by bound))")
        ctes.append(f"bf{i} as (select *, row_number() over (partition by ts order by bound) as rn from bh{i} where c >= rank)")
        ctes.append(f"n9{i} as (select ts, case when total = 0 then null when le = '+Inf' then 1.0 else low + (bound - low) * (rank - below) / (c - below) end as value from bf{i} where rn = 1)")
        ctes.append(_sustained_sql(f"n9{i}", f"f9{i}", f"value > {least}", seconds))
        out.append(f"select '{name}' as alert, * from f9{i}")
    return f"with {', '.join(ctes)} {' union all '.join(out)}"


@query(_alerts_sql())
def wn11_alerts(s, d):
    """Every alert rule over scrapes of two nodes."""
    return promql.alerts(_alert_scrapes(s, d)).select("alert", "started", "ended", "fires_at")


@query("select event_id, user_id, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1e6, 3) as at_seconds from events")
def wn7_relative_seconds(s, d):
    rows = _events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return metrics.relative_seconds(rows, "ts", start).select("event_id", "user_id", "at_seconds")


@query(f"with t as (select event_type, min({_EPOCH}) as at_seconds from events group by 1), o as (select *, row_number() over (order by at_seconds) - 1 as ordinal from t) select event_type, ordinal, case when ordinal >= 6 then 'final' when ordinal >= 5 then 'restart-pending' when ordinal >= 3 then 'failover' when ordinal >= 2 then 'crash' else 'initial' end as mode, case when ordinal >= 6 then 'final' when ordinal >= 5 then null when ordinal >= 3 then 'failover' when ordinal >= 2 then null else 'initial' end as checkpoint from o")
def wn8_checkpoints(s, d):
    # First events of one second go by their exact time and their number: in one decimal, as a struct's minimum would sort all rows.
    first = F.min(F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * F.lit(Decimal(10**19)) + e_())
    timeline = _events(s, d).groupBy("event_type").agg(F.min(promql.epoch("ts")).alias("at_seconds"), first.alias("first"))
    return evidence.checkpoints(timeline, ties=("first",)).select("event_type", "ordinal", "mode", "checkpoint")


@query(f"with {_OBS}, b as (select operation, case when duration_ns <= 100000 then 0 when duration_ns <= 500000 then 1 when duration_ns <= 1000000 then 2 when duration_ns <= 5000000 then 3 when duration_ns <= 10000000 then 4 when duration_ns <= 50000000 then 5 else 6 end as bucket from obs) select operation, bucket, count(*) as observations from b group by 1, 2")
def ag11_observed_buckets(s, d):
    own = metrics.bucket(F.col("duration_ns") / 1e9)
    return _observations(s, d).groupBy("operation", F.coalesce(own, F.lit(10)).alias("bucket")).agg(F.count("*").alias("observations"))


@query("select event_id, sum(case when event_type in ('view', 'click', 'purchase') then 1 else -1 end) over (partition by user_id % 10 order by event_id rows unbounded preceding) as in_flight from events")
def ag14_in_flight(s, d):
    moves = _events(s, d).select((u_() % 10).alias("node_id"), "event_id", F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(-1).alias("delta"))
    return metrics.in_flight(moves, ("node_id",), "event_id").select("event_id", "in_flight")


@query("select user_id, round(count(*) / nullif(max(event_id) - min(event_id), 0), 9) as per_second, round(count(*) / count(distinct event_id // 100), 9) as mean_batch, case when user_id % 2 = 0 then 0.0 else 2.5 end as guarded from events group by user_id")
def ag17_throughput(s, d):
    per = _events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id")).alias("t"), F.count_distinct(F.floor(e_() / 100)).alias("b"))
    guarded = metrics.mean_batch(F.lit(5), F.when(u_() % 2 == 0, 0).otherwise(2))
    return per.select("user_id", F.round(metrics.throughput(F.col("n"), F.col("t")), 9).alias("per_second"), F.round(metrics.mean_batch(F.col("n"), F.col("b")), 9).alias("mean_batch"), guarded.alias("guarded"))


@query("select cast(sum(greatest(event_id % 6 - 1, 0)) as bigint) as waiters from events")
def ag20_waiters(s, d):
    return metrics.waiters(_events(s, d).select((e_() % 6).alias("users")))


@query("select count(*) filter (where event_id % 11 = 0) as requests_busy from events")
def ag13_busy_total(s, d):
    return metrics.busy_total(_observations(s, d))
