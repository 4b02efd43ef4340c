"""Range functions and alert conditions over scraped samples.

Series are (by..., ts, value). Times are integer epoch seconds. A long series isn't one task's: windows run within blocks
of `block` seconds (or whatever unit the order has), and what crosses an edge is carried from the rows or the sums of the
block before. Samples of a series have times of their own; of equal ones any order holds, or that of the columns `ties`
where a function takes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .metrics import attached


def epoch(ts: str | Column) -> Column:
    """Whole epoch seconds of a timestamp with or without zone (session zone UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


BLOCK = 86_400


def _blocked(rows: DataFrame, ts: str, block: int) -> DataFrame:
    return rows.withColumn("__b", F.floor(F.col(ts) / block))


def _with_edges(rows: DataFrame, ts: str, seconds: int, block: int) -> DataFrame:
    """Rows in their block, and once more (`__ghost`) in the next one if that one's ranges reach back to them."""
    if seconds > block:
        raise ValueError(f"a range of {seconds} is longer than a block of {block}")
    dealt = _blocked(rows, ts, block)
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("g"))
    late = F.when(F.col(ts) + seconds >= (F.col("__b") + 1) * block, F.struct((F.col("__b") + 1).alias("b"), F.lit(True).alias("g")))
    return dealt.withColumn("__x", F.explode(F.array_compact(F.array(own, late)))).withColumn("__b", F.col("__x.b")).withColumn("__ghost", F.col("__x.g")).drop("__x")


def _place(ts: str, ties: tuple[str, ...]) -> Column:
    """A sample's place in its series; null without a time."""
    return F.when(F.col(ts).isNotNull(), F.struct(ts, *ties))


def previous(samples: DataFrame, by: tuple[str, ...], ts: str, name: str, value: Column, block: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `name`, the `value` of the series' sample before; null for the first one. Samples of one `ts` go by `ties`."""
    dealt = _blocked(samples, ts, block).withColumn("__v", value)
    lasts = dealt.groupBy(*by, "__b").agg(F.max_by(F.struct("__v"), _place(ts, ties)).alias("__last"))
    before = lasts.withColumn("__before", F.lag("__last").over(W.partitionBy(*by).orderBy("__b"))).drop("__last")
    inside = dealt.withColumn("__prev", F.lag(F.struct("__v")).over(W.partitionBy(*by, "__b").orderBy(ts, *ties)))
    met = attached(inside, before, [*by, "__b"])
    return met.withColumn(name, F.coalesce("__prev", "__before")["__v"]).drop("__b", "__v", "__prev", "__before")


def _grown(now: Column, before: Column) -> Column:
    return F.when(before.isNull(), None).when(now < before, now).otherwise(now - before)


def increases(samples: DataFrame, by: tuple[str, ...], ts: str = "ts", value: str = "value", block: int = BLOCK) -> DataFrame:
    """Add `increase` since the previous sample; a counter that fell was reset and counts from 0. The first has none."""
    return previous(samples, by, ts, "__was", F.col(value), block).withColumn("increase", _grown(F.col(value), F.col("__was"))).drop("__was")


def rate(samples: DataFrame, by: tuple[str, ...], ts: str = "ts", value: str = "value", seconds: int = 300, block: int = BLOCK) -> DataFrame:
    """Add `rate`: the increase per second between the samples of the range (ts - seconds, ts], null if it has but one.

    The increase from a sample before the range isn't in it. There is no extrapolation to the range's ends.
    """
    dealt = _with_edges(samples, ts, seconds, block)
    series = W.partitionBy(*by, "__b").orderBy(ts)
    within = series.rangeBetween(-seconds + 1, 0)
    grown = dealt.withColumn("__up", F.coalesce(_grown(F.col(value), F.lag(value).over(series)), F.lit(0)))
    held = grown.withColumn("__sum", F.sum("__up").over(within) - F.first("__up").over(within)).withColumn("__n", F.count("*").over(within))
    return held.filter(~F.col("__ghost")).withColumn("rate", F.when(F.col("__n") > 1, F.col("__sum") / seconds)).drop("__b", "__ghost", "__up", "__sum", "__n")


def event_rate(events: DataFrame, by: tuple[str, ...], ts: str, seconds: int = 300, name: str = "events_in_range", block: int = BLOCK) -> DataFrame:
    """Add the number of the series' events in the range up to each event, both ends included."""
    dealt = _with_edges(events, ts, seconds, block)
    counted = dealt.withColumn(name, F.count("*").over(W.partitionBy(*by, "__b").orderBy(ts).rangeBetween(-seconds, 0)))
    return counted.filter(~F.col("__ghost")).drop("__b", "__ghost")


def instant(samples: DataFrame, how: str, by: tuple[str, ...] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """sum, max, min, avg or count over series at each time, by labels."""
    return samples.groupBy(ts, *by).agg(F.expr(f"{how}(`{value}`)").alias(value))


def quantile(buckets: DataFrame, q: float, by: tuple[str, ...], le: str = "le", count: str = "cumulative_count") -> DataFrame:
    """(by..., quantile) by linear interpolation in the bucket that holds the rank; above the last bound, that bound.

    `le` is a double (infinity for the last bucket). A group's buckets are a handful of rows, folded as an array.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(count).cast("double").alias("c"))))
    per = buckets.groupBy(*by).agg(rows.alias("b"))
    total = F.element_at("b", -1)["c"]
    rank = F.lit(q) * total
    at = F.array_position(F.transform("b", lambda x: x["c"] >= rank), True).cast("int")
    low = F.when(at > 1, F.get("b", at - 2)["le"]).otherwise(F.lit(0.0))
    below = F.when(at > 1, F.get("b", at - 2)["c"]).otherwise(F.lit(0.0))
    here = F.get("b", at - 1)
    last = F.get("b", F.size("b") - 2)["le"]
    inside = low + (here["le"] - low) * (rank - below) / F.nullif(here["c"] - below, F.lit(0.0))
    out = F.when(total == 0, None).when(here["le"] == float("inf"), last).otherwise(F.coalesce(inside, low))
    return per.select(*by, out.alias("quantile"))


def sustained(samples: DataFrame, condition: Column, seconds: int, by: tuple[str, ...] = (), ts: str = "ts", block: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """(by..., started, ended, fires_at) of each run of samples in which the condition held for at least `seconds`.

    A run starts where the condition begins to hold; every later sample of it takes the last start before it, from its block
    or from the blocks before. An alert fires at the first sample that old. Samples of one `ts` go by `ties`; without them
    any order of theirs holds, and with it which runs there are.
    """
    marked = samples.withColumn("__on", F.coalesce(condition, F.lit(False)))
    edge = previous(marked, by, ts, "__was", F.col("__on"), block, ties).withColumn("__start", F.when(F.col("__on") & ~F.coalesce("__was", F.lit(False)), _place(ts, ties)))
    dealt = _blocked(edge, ts, block)
    starts = dealt.groupBy(*by, "__b").agg(F.max("__start").alias("__late"))
    carried = starts.withColumn("__carried", F.max("__late").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__late")
    inside = dealt.withColumn("__own", F.max("__start").over(W.partitionBy(*by, "__b").orderBy(ts, *ties).rowsBetween(W.unboundedPreceding, 0)))
    runs = attached(inside, carried, [*by, "__b"]).filter("__on").withColumn("started", F.coalesce("__own", "__carried"))
    runs = runs.withColumn("__run", F.col("started")).withColumn("started", F.col("__run")[ts])
    out = runs.groupBy(*by, "__run", "started").agg(F.max(ts).alias("ended"), F.min(F.when(F.col(ts) - F.col("started") >= seconds, F.col(ts))).alias("fires_at"))
    return out.filter("fires_at is not null").select(*by, "started", "ended", "fires_at")


#: Fixed values, alert name: (metric, aggregation, operator, threshold, seconds, whether the rate over five minutes is meant).
RULES = {
    "NoLeader": ("raft_leader", "sum", "=", 0, 30, False),
    "FrequentLeaderChanges": ("raft_leadership_changes_total", "sum", ">", 0.1, 300, True),
    "FollowerReplicationLag": ("raft_peer_replication_lag", "max", ">", 1000, 300, False),
    "HighApplyLag": ("raft_apply_lag", "max", ">", 100, 300, False),
    "HighBusyRate": ("requests_busy_total", "sum", ">", 1, 300, True),
    "PeerReconnectStorm": ("transport_connections_dialed_total", "sum", ">", 5, 300, True),
    "TransportQueuePressure": ("transport_waiters", "max", ">", 0, 300, False),
    "MetricsTargetDown": ("up", "min", "=", 0, 120, False),
}
#: Fixed values, alert name: (bucket metric, label, quantile, threshold in seconds, seconds).
LATENCY_RULES = {
    "HighRequestLatency": ("request_duration_seconds_bucket", "operation", 0.95, 0.25, 600),
    "HighPersistenceLatency": ("persistence_duration_seconds_bucket", "domain", 0.95, 0.1, 600),
}


def quantile_series(buckets: DataFrame, q: float, label: str, series: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """(ts, label, value): the quantile of five-minute rates of bucket counters (ts, series..., label, le, value), summed by le and label."""
    rated = rate(buckets, (*series, label, "le"), block=block).filter("rate is not null")
    summed = rated.groupBy("ts", label, "le").agg(F.sum("rate").alias("c"))
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    return quantile(summed.withColumn("bound", bound), q, ("ts", label), "bound", "c").select("ts", label, F.col("quantile").alias("value"))


def alerts(scrapes: DataFrame, series: tuple[str, ...] = ("node_id", "labels_key"), labels: str = "labels", block: int = BLOCK) -> DataFrame:
    """(alert, started, ended, fires_at) of all rules over scrapes (ts, metric, series..., labels: map, value).

    Latency rules hold for each value of their label on its own; without a `labels` column they are left out.
    """
    out = None
    for name, (metric, how, op, least, seconds, rated) in RULES.items():
        own = scrapes.filter(F.col("metric") == metric)
        if rated:
            own = rate(own, series, block=block).filter("rate is not null").withColumn("value", F.col("rate"))
        now = instant(own, how)
        hold = F.col("value") == F.lit(least) if op == "=" else F.col("value") > F.lit(least)
        found = sustained(now, hold, seconds, block=block).select(F.lit(name).alias("alert"), "started", "ended", "fires_at")
        out = found if out is None else out.unionByName(found)
    for name, (metric, label, q, least, seconds) in LATENCY_RULES.items() if labels in scrapes.columns else ():
        of = lambda k: F.try_element_at(F.col(labels), F.lit(k))  # noqa: B023, E731
        own = scrapes.filter(F.col("metric") == metric).select("ts", *series, of(label).alias(label), of("le").alias("le"), "value")
        rest = tuple(c for c in series if c != "labels_key")
        now = quantile_series(own, q, label, rest, block)
        found = sustained(now, F.col("value") > F.lit(least), seconds, (label,), block=block)
        out = out.unionByName(found.select(F.lit(name).alias("alert"), "started", "ended", "fires_at"))
    return out
