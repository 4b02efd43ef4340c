"""Operational metrics: counters, gauges, cumulative histograms, lags, percentiles, exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import known_operation, known_status
from ..schemas import BOUNDS, OPERATIONS, STATUSES


def requests_total(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., operation, status, requests) over the whole label grid, with zeros. Unknown operations aren't counted,
    unknown statuses count as internal. The grid is 21 rows for each group."""
    seen = obs.select(*by, known_operation(F.col("operation")).alias("operation"), known_status(F.col("status")).alias("status")).filter("operation is not null")
    counts = seen.groupBy(*by, "operation", "status").agg(F.count("*").alias("requests"))
    labels = F.explode(F.array(*[F.struct(F.lit(o).alias("operation"), F.lit(s).alias("status")) for o in OPERATIONS for s in STATUSES])).alias("x")
    groups = counts.select(*by).distinct() if by else obs.sparkSession.range(1)
    grid = groups.select(*by, labels).select(*by, "x.operation", "x.status")
    return grid.join(counts, [*by, "operation", "status"], "left").withColumn("requests", F.coalesce("requests", F.lit(0)))


def busy_total(obs: DataFrame) -> DataFrame:
    return obs.filter("status = 'busy'").agg(F.count("*").alias("requests_busy"))


def bucket(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The index of the one bucket that a value falls in: the first bound that isn't below it; null above the last."""
    out = None
    for i, b in enumerate(bounds):
        out = F.when(value <= F.lit(b), i) if out is None else out.when(value <= F.lit(b), i)
    return out


def histogram(obs: DataFrame, value: Column, by: tuple[str, ...], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by..., le, cumulative_count) for all bounds and +Inf (le as text). Negative values count as 0.

    Each row is reduced to a bucket number and counted before the shuffle; accumulation runs over a fixed number of
    counts in one row for each group.
    """
    n = len(bounds)
    one = obs.select(*by, F.coalesce(bucket(F.greatest(value, F.lit(0)), bounds), F.lit(n)).alias("__b"))
    per = one.groupBy(*by).agg(*[F.count_if(F.col("__b") <= i).alias(f"__c{i}") for i in range(n + 1)])
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("le"), F.col(f"__c{i}").alias("cumulative_count")) for i, x in enumerate(names)])).alias("x")
    return per.select(*by, rows).select(*by, "x.le", "x.cumulative_count")


def histogram_totals(obs: DataFrame, nanos: Column, by: tuple[str, ...]) -> DataFrame:
    """(by..., sum_ns, count)."""
    return obs.groupBy(*by).agg(F.sum(F.greatest(nanos, F.lit(0))).alias("sum_ns"), F.count("*").alias("count"))


def floor_percentiles(obs: DataFrame, value: str, by: tuple[str, ...], points: tuple[float, ...] = (0.5, 0.95, 0.99), width: float = 1000.0) -> DataFrame:
    """(by..., n, p50, p95, ...): the value at the floor of p * (n - 1) in sorted order, without interpolation.

    No group is sorted in one task: distinct values are counted first (partial sums), then ranked within ranges of `width`
    of the value, and only the counts of ranges are accumulated over a group.
    """
    counts = obs.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__b", F.floor(F.col(value) / F.lit(width)))
    group = W.partitionBy(*by)
    per = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__size"))
    per = per.withColumn("__ahead", F.coalesce(F.sum("__size").over(group.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__size").over(group)).drop("__size")
    inside = W.partitionBy(*by, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = attached(counts.withColumn("__in", F.sum("__n").over(inside)), per, [*by, "__b"]).withColumn("__to", F.col("__in") + F.col("__ahead"))
    place = lambda p: F.floor(F.lit(p) * (F.col("__all") - 1)) + 1
    at = lambda p: F.max(F.when((F.col("__to") - F.col("__n") < place(p)) & (place(p) <= F.col("__to")), F.col(value))).alias(f"p{100 * p:g}".replace(".", "_"))
    return ranked.groupBy(*by).agg(F.max("__all").alias("n"), *[at(p) for p in points])


def attached(rows: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the columns of their block. Keys may be null; a block's rows and its one row hash to the same place."""
    other = blocks.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in blocks.columns if c not in on])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(other, same, "left").drop(*[f"__k{i}" for i in range(len(on))])


def write_amplification(obs: DataFrame, physical: str, logical: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., physical_bytes, logical_bytes, amplification); null without logical bytes."""
    out = obs.groupBy(*by).agg(F.sum(physical).alias("physical_bytes"), F.sum(logical).alias("logical_bytes"))
    return out.withColumn("amplification", F.col("physical_bytes") / F.nullif("logical_bytes", F.lit(0)))


def throughput(n: Column, seconds: Column) -> Column:
    return n / F.nullif(seconds, F.lit(0))


def mean_batch(entries: Column, batches: Column) -> Column:
    return F.when(batches == 0, 0.0).otherwise(entries / F.nullif(batches, F.lit(0)))


def counters(obs: DataFrame, by: tuple[str, ...], **conditions: str) -> DataFrame:
    """(by..., one count for each named SQL condition)."""
    return obs.groupBy(*by).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()])


def gauges(obs: DataFrame, value: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """The last value of each series."""
    return obs.groupBy(*by).agg(F.max_by(value, order).alias(value))


def _running(changes: DataFrame, by: tuple[str, ...], order: str, delta: str, width: float) -> tuple[DataFrame, DataFrame]:
    """(rows with `__b` and the running sum `__in` within ranges of `width` of the order, ranges with the sum `__ahead` of them)."""
    dealt = changes.withColumn("__b", F.floor(F.col(order) / F.lit(width)))
    rows = dealt.withColumn("__in", F.sum(delta).over(W.partitionBy(*by, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    per = dealt.groupBy(*by, "__b").agg(F.sum(delta).alias("__sum"))
    ahead = F.coalesce(F.sum("__sum").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows, per.withColumn("__ahead", ahead).drop("__sum")


def in_flight(changes: DataFrame, by: tuple[str, ...] = ("node_id",), order: str = "ts", delta: str = "delta", width: float = 4096.0) -> DataFrame:
    """Add `in_flight`, the running sum of +1 and -1 over a number or time; sums run within ranges of `width` of it."""
    rows, per = _running(changes, by, order, delta, width)
    return attached(rows, per, [*by, "__b"]).withColumn("in_flight", F.col("__in") + F.col("__ahead")).drop("__b", "__in", "__ahead")


def high_water(changes: DataFrame, by: tuple[str, ...] = ("node_id",), order: str = "ts", delta: str = "delta", width: float = 4096.0) -> DataFrame:
    """(by..., high_water): the peaks of ranges are joined, not the rows."""
    rows, per = _running(changes, by, order, delta, width)
    peaks = rows.groupBy(*by, "__b").agg(F.max("__in").alias("__peak"))
    return attached(peaks, per, [*by, "__b"]).groupBy(*by).agg(F.max(F.col("__peak") + F.col("__ahead")).alias("high_water"))


def waiters(sessions: DataFrame, users: str = "users") -> DataFrame:
    """Calls that wait for a shared session: all of its users but one."""
    return sessions.agg(F.coalesce(F.sum(F.greatest(F.col(users) - 1, F.lit(0))), F.lit(0)).alias("waiters"))


def apply_lag(commit: Column, applied: Column) -> Column:
    return F.greatest(commit - applied, F.lit(0))


def peer_lag(last_index: Column, match: Column) -> Column:
    return F.greatest(last_index - match, F.lit(0))


def changes(samples: DataFrame, value: str, by: tuple[str, ...], order: str) -> DataFrame:
    """Rows whose value differs from the series' previous one, with it (`previous`)."""
    w = W.partitionBy(*by).orderBy(order)
    return samples.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def relative_seconds(rows: DataFrame, ts: str, start: Column) -> DataFrame:
    """Add `at_seconds`, seconds after `start` to three places."""
    return rows.withColumn("at_seconds", F.round((F.unix_micros(ts) - F.unix_micros(start)) / 1e6, 3))


# Exposition: a text line for each sample.


def _number(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def histogram_lines(buckets: DataFrame, totals: DataFrame, name: str, label: str | None = None) -> DataFrame:
    """(ord, line) of a histogram in text exposition format; `label` is the label column, if it has one."""
    by = [label] if label else []
    quoted = F.concat(F.lit(f'{label}="'), F.col(label), F.lit('"')) if label else F.lit("")
    inner = F.concat(quoted, F.lit(",")) if label else F.lit("")
    braces = F.concat(F.lit("{"), quoted, F.lit("}")) if label else F.lit("")
    key = F.col(label) if label else F.lit("")
    order = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    lines = buckets.select(*by, F.struct(key.alias("k"), F.lit(0).alias("part"), order.alias("n")).alias("ord"), F.concat(F.lit(f"{name}_bucket{{"), inner, F.lit('le="'), F.col("le"), F.lit('"} '), _number(F.col("cumulative_count"))).alias("line"))
    seconds = F.format_string("%.9g", F.col("sum_ns") / 1e9)
    seconds = F.regexp_replace(F.regexp_replace(seconds, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    sums = totals.select(*by, F.struct(key.alias("k"), F.lit(1).alias("part"), F.lit(0.0).alias("n")).alias("ord"), F.concat(F.lit(f"{name}_sum"), braces, F.lit(" "), seconds).alias("line"))
    counts = totals.select(*by, F.struct(key.alias("k"), F.lit(2).alias("part"), F.lit(0.0).alias("n")).alias("ord"), F.concat(F.lit(f"{name}_count"), braces, F.lit(" "), _number(F.col("count"))).alias("line"))
    return lines.unionByName(sums).unionByName(counts).select("ord", "line")


def gauge_lines(samples: DataFrame, prefix: str) -> DataFrame:
    """(line) for samples (metric, labels map, value), labels sorted by name; with a TYPE line for unlabelled ones."""
    pairs = F.array_sort(F.map_entries("labels"))
    quoted = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    name = F.concat(F.lit(prefix), F.col("metric"))
    return samples.select("metric", F.concat(name, F.when(F.size("labels") > 0, F.concat(F.lit("{"), quoted, F.lit("}"))).otherwise(""), F.lit(" "), _number(F.col("value"))).alias("line"))


def parse_exposition(lines: DataFrame, column: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., metric, labels, value) of exposition lines; comments and blank lines are dropped."""
    pattern = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})? ([-+0-9.eE]+|NaN|[+-]Inf)$'
    c = F.col(column)
    found = lines.filter(c.rlike(pattern)).select(*by, F.regexp_extract(c, pattern, 1).alias("metric"), F.regexp_extract(c, pattern, 2).alias("l"), F.regexp_extract(c, pattern, 3).alias("v"))
    names, values = F.regexp_extract_all("l", F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="[^"]*"'), F.lit(1)), F.regexp_extract_all("l", F.lit(r'="([^"]*)"'), F.lit(1))
    return found.select(*by, "metric", F.map_from_arrays(names, values).alias("labels"), F.col("v").cast("double").alias("value"))
