"""Status and metrics projections of recorded node states, their text forms, and the health of scrapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import mode_name, role_name
from ..schemas import OPERATIONS, STATUSES
from . import metrics

#: A recorded node state: what the projections read.
NODE = (
    "node_id bigint, role int, current_term bigint, voted_for bigint, leader_id bigint, last_log_index bigint, commit_index bigint, last_applied bigint, "
    "snapshot_index bigint, snapshot_term bigint, mode int, voters array<struct<id:bigint,addr:string>>, old_voters array<struct<id:bigint,addr:string>>, new_voters array<struct<id:bigint,addr:string>>, apply_error string"
)
_NO_VOTERS = "array<struct<id:bigint,addr:string>>"


def full_status(nodes: DataFrame) -> DataFrame:
    """The whole status of every node, leader or not; an unknown leader is 0. Voters are sorted, and only those of the mode are there."""
    joint = F.col("mode") == 2
    none = F.array().cast(_NO_VOTERS)
    voters = lambda c, on: F.when(on, F.coalesce(F.array_sort(c), none)).otherwise(none).alias(c)
    return nodes.select(
        "node_id",
        role_name(F.col("role")).alias("role"),
        F.col("current_term").alias("term"),
        F.coalesce("leader_id", F.lit(0)).cast("bigint").alias("leader_id"),
        "last_log_index",
        "commit_index",
        "last_applied",
        metrics.apply_lag(F.col("commit_index"), F.col("last_applied")).alias("apply_lag"),
        "snapshot_index",
        "snapshot_term",
        mode_name(F.when(joint, 2).otherwise(1)).alias("membership"),
        voters("voters", ~joint),
        voters("old_voters", joint),
        voters("new_voters", joint),
    )


def metrics_snapshot(nodes: DataFrame, proposals: DataFrame, transport: DataFrame) -> DataFrame:
    """The fields that an exposition shows of a node, its proposals (node_id, ...) and its transport (node_id, ...); counts below 0 are 0."""
    clamp = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(c)
    own = [c for c in proposals.columns if c != "node_id"]
    sent = [c for c in transport.columns if c != "node_id"]
    met = nodes.join(proposals, "node_id", "left").join(transport, "node_id", "left")
    return met.select("node_id", F.col("current_term").alias("term"), "commit_index", "last_applied", "last_log_index", role_name(F.col("role")).alias("role"), (role_name(F.col("role")) == "leader").alias("leader"), *map(clamp, (*own, *sent)))


def values(nodes: DataFrame) -> DataFrame:
    """(node_id, name, value) for the single values that a node answers, as text; what it doesn't know is null."""
    names = {
        "role": role_name(F.col("role")),
        "term": F.col("current_term").cast("string"),
        "vote": F.col("voted_for").cast("string"),
        "leader_hint": F.col("leader_id").cast("string"),
        "commit_index": F.col("commit_index").cast("string"),
        "last_index": F.col("last_log_index").cast("string"),
        "snapshot_index": F.col("snapshot_index").cast("string"),
        "snapshot_term": F.col("snapshot_term").cast("string"),
        "last_applied": F.col("last_applied").cast("string"),
        "apply_error": F.col("apply_error"),
    }
    return nodes.select("node_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in names.items()])).alias("x")).select("node_id", "x.name", "x.value")


def probed(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """Every expected node (node_id) with its answer; one that didn't answer is unreachable."""
    return expected.join(answers.withColumn("__there", F.lit(True)), "node_id", "left").withColumn("reachable", F.col("__there").isNotNull()).drop("__there")


def printed(statuses: DataFrame) -> DataFrame:
    """Add `text`, the status as people read it: a `name: value` line each, then the voters. Input: see `full_status`."""
    line = lambda name, value: F.concat(F.lit(f"{name}:".ljust(16)), value.cast("string"), F.lit("\n"))
    voters = lambda head, c: F.concat(F.lit(f"{head}:\n"), F.array_join(F.transform(c, lambda v: F.concat(F.lit("  "), v["id"].cast("string"), F.lit(" "), v["addr"], F.lit("\n"))), ""))
    fields = [
        line("node", F.col("node_id")),
        line("role", F.col("role")),
        line("term", F.col("term")),
        line("leader", F.when(F.col("leader_id") == 0, "unknown").otherwise(F.col("leader_id").cast("string"))),
        *[line(c.replace("_", "-"), F.col(c)) for c in ("last_log_index", "commit_index", "last_applied", "apply_lag", "snapshot_index", "snapshot_term")],
        line("membership", F.col("membership")),
    ]
    tail = F.when(F.col("membership") == "joint", F.concat(voters("old voters", F.col("old_voters")), voters("new voters", F.col("new_voters")))).otherwise(voters("voters", F.col("voters")))
    return statuses.withColumn("text", F.concat(*fields, tail))


def asked(addresses: list[str], every: bool = False) -> list[str]:
    """The addresses that a status question goes to: the first one, or all."""
    return addresses if every else addresses[:1]


def bundle_summary(spark: SparkSession, root: str) -> DataFrame:
    """(section, item, value) of an evidence bundle, for a report."""
    from .. import schemas
    from . import evidence

    read = lambda name, schema: evidence.read_json(spark, f"{root}/{name}.json", schema)
    m = read("manifest", schemas.MANIFEST).select(F.struct("*").alias("m"))
    w = read("workload-summary", schemas.WORKLOAD).select(F.struct("*").alias("w"))
    a = read("acknowledged-writes-summary", schemas.ACK_SUMMARY + ", acknowledged_before_crash bigint, acknowledged_after_failover bigint").select(F.struct("*").alias("a"))
    lead = lambda n, c: evidence.leader_of(evidence.status_rows(spark, f"{root}/{n}-status.json")).agg(F.struct(F.max("node_key").alias("node_key"), F.max("term").alias("term")).alias(c))
    one = m.join(w).join(a).join(lead("initial", "i")).join(lead("final", "z"))
    rows = [
        ("LOAD", "workers", "m.workload.workers"),
        ("LOAD", "put percent", "m.workload.put_percent"),
        ("LOAD", "get percent", "m.workload.get_percent"),
        ("INITIAL", "leader", "i.node_key"),
        ("INITIAL", "term", "i.term"),
        ("INITIAL", "acknowledged", "a.acknowledged_before_crash"),
        ("FAILURE", "leader", "m.failure.leader_id"),
        ("RECOVERY", "leader", "z.node_key"),
        ("RECOVERY", "term", "z.term"),
        ("RECOVERY", "acknowledged", "a.acknowledged_after_failover"),
        ("CLIENT OUTCOMES", "ambiguous writes", "w.ambiguous_write_outcomes"),
        ("CLIENT OUTCOMES", "retired sessions", "w.retired_sessions"),
        ("CLIENT OUTCOMES", "read transients", "w.transient_read_failures"),
        ("CLIENT OUTCOMES", "stale requests", "w.stale_requests"),
        ("CLIENT OUTCOMES", "conflicts", "w.request_conflicts"),
        ("REJOIN", "restarted", "m.recovery.restarted_node_id"),
        ("VERIFY", "acknowledged", "a.total_acknowledged"),
        ("VERIFY", "verified", "a.verified_acknowledged"),
        ("RESULT", "status", "m.result.status"),
    ]
    items = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), F.col(c).cast("string").alias("value")) for s, i, c in rows])
    return one.select(F.explode(items).alias("x")).select("x.*")


def event_lines(rows: DataFrame, prefix: tuple[str, ...] = ("time", "level", "msg", "event")) -> DataFrame:
    """(line): structured log lines as JSON, the usual fields first."""
    rest = [c for c in rows.columns if c not in prefix]
    return rows.select(F.to_json(F.struct(*[c for c in prefix if c in rows.columns], *rest)).alias("line"))


# Scrapes.


def scrape_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder that scrapes are dropped in, a text file each, as a stream of (file, value) lines."""
    return spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).format("text").load(path).select(F.col("_metadata.file_name").alias("file"), "value")


def health(nodes: DataFrame) -> DataFrame:
    """(node_id, healthy, ready): healthy without an apply error; ready if healthy and a leader is known."""
    good = F.col("apply_error").isNull()
    return nodes.select("node_id", good.alias("healthy"), (good & F.col("leader_id").isNotNull()).alias("ready"))


#: The families of an exposition without labels, behind its prefix: gauges, then counters.
GAUGES = ("raft_leader", "raft_commit_index", "raft_last_applied", "raft_last_log_index", "raft_apply_lag", "proposal_queue_depth", "requests_inflight", "transport_active_connections", "transport_waiters")
COUNTERS = (
    "raft_elections_total",
    "raft_leadership_changes_total",
    "raft_term_changes_total",
    "raft_log_logical_bytes_appended_total",
    "raft_log_physical_bytes_written_total",
    "raft_log_rotations_total",
    "raft_log_truncations_total",
    "proposals_admitted_total",
    "proposals_busy_total",
    "proposal_batches_total",
    "proposal_batch_entries_total",
    "requests_busy_total",
    "transport_connections_dialed_total",
    "transport_connections_reused_total",
    "transport_connections_closed_total",
    "transport_send_failures_total",
    "readindex_total",
    "readindex_failures_total",
    "snapshots_created_total",
    "snapshot_install_total",
    "snapshot_install_failures_total",
    "snapshot_install_bytes_total",
)
ROLES = ("leader", "follower", "candidate")
PEER_FIELDS = {"match": "raft_peer_match_index", "next": "raft_peer_next_index", "lag": "raft_peer_replication_lag", "rpcs": "raft_replication_rpcs_total", "bytes": "raft_replication_bytes_total", "failures": "raft_replication_failures_total", "stale": "raft_replication_stale_responses_total"}


def exposition(snapshots: DataFrame, peers: DataFrame | None = None, requests: DataFrame | None = None, histograms: dict[str, tuple[DataFrame, DataFrame, str | None]] | None = None, prefix: str = "") -> DataFrame:
    """(node_id, ord, line): the whole exposition of every node, in order of `ord`.

    `snapshots` (node_id, term, role, and a column for each of GAUGES and COUNTERS that is known; others are 0); `peers`
    (node_id, peer, last_log_index, match, next, rpcs, bytes, failures, stale); `requests` (node_id, operation, status, requests);
    `histograms`: name to (buckets, totals, label), as from `metrics.histogram`, each with node_id. Peers go by number.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").cast("string") if c in snapshots.columns else F.lit("0")
    lines: list[tuple[Column, Column]] = []
    order = lambda *n: F.struct(*[F.lit(float(x)).alias(f"p{i}") if isinstance(x, int) else x.alias(f"p{i}") for i, x in enumerate(n)])

    def add(part: int, at: int, line: Column) -> None:
        lines.append((order(part, at, 0, 0), line))

    typed = lambda n, kind, value: (F.lit(f"# TYPE {prefix}{n} {kind}"), F.concat(F.lit(f"{prefix}{n} "), value))
    for i, line in enumerate(typed("raft_term", "gauge", F.col("term").cast("string"))):
        add(0, i, line)
    for i, r in enumerate(ROLES):
        add(1, i, F.concat(F.lit(f'{prefix}raft_role{{role="{r}"}} '), F.when(F.col("role") == r, "1").otherwise("0")))
    for i, g in enumerate(GAUGES):
        for j, line in enumerate(typed(g, "gauge", text(g))):
            add(2, 2 * i + j, line)
    for i, line in enumerate(typed("raft_log_segments", "gauge", text("raft_log_segments"))):
        add(3, i, line)
    for i, c in enumerate(COUNTERS):
        for j, line in enumerate(typed(c, "counter", text(c))):
            add(4, 2 * i + j, line)
    for i, c in enumerate(("snapshot_size_bytes", "snapshot_last_index")):
        add(5, i, F.concat(F.lit(f"{prefix}{c} "), text(c)))
    out = snapshots.select("node_id", F.explode(F.array(*[F.struct(o.alias("ord"), x.alias("line")) for o, x in lines])).alias("x")).select("node_id", "x.ord", "x.line")
    if requests is not None:
        place = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)).cast("double")
        line = F.concat(F.lit(f'{prefix}requests_total{{operation="'), F.col("operation"), F.lit('",status="'), F.col("status"), F.lit('"} '), F.col("requests").cast("string"))
        out = out.unionByName(requests.select("node_id", order(6, place("operation", OPERATIONS), place("status", STATUSES), 0).alias("ord"), line.alias("line")))
    for i, (name, (buckets, totals, label)) in enumerate((histograms or {}).items()):
        out = out.unionByName(_histogram(buckets, totals, f"{prefix}{name}", label, 7 + i))
    if peers is not None:
        known = peers.withColumn("lag", metrics.peer_lag(F.col("last_log_index"), F.col("match")))
        each = [F.struct(order(1000, F.col("peer").cast("double"), i, 0).alias("ord"), F.concat(F.lit(f'{prefix}{n}{{peer="'), F.col("peer").cast("string"), F.lit('"} '), F.col(c).cast("string")).alias("line")) for i, (c, n) in enumerate(PEER_FIELDS.items())]
        out = out.unionByName(known.select("node_id", F.explode(F.array(*each)).alias("x")).select("node_id", "x.ord", "x.line"))
    return out


def _histogram(buckets: DataFrame, totals: DataFrame, name: str, label: str | None, part: int) -> DataFrame:
    """The lines of one histogram: label values in text order, then buckets by bound, the sum and the count."""
    by = ["node_id", *([label] if label else [])]
    quoted = F.concat(F.lit(f'{label}="'), F.col(label), F.lit('"')) if label else F.lit("")
    inner = F.concat(quoted, F.lit(",")) if label else F.lit("")
    braces = F.concat(F.lit("{"), quoted, F.lit("}")) if label else F.lit("")
    # Label vocabularies are fixed and short; their rank is the order of their lines.
    rank = totals.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("__all")) if label else None
    at = F.array_position("__all", F.col(label)).cast("double") if label else F.lit(0.0)
    ranked = lambda d: d.crossJoin(F.broadcast(rank)) if label else d
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    order = lambda kind, n: F.struct(F.lit(float(part)).alias("p0"), at.alias("p1"), F.lit(float(kind)).alias("p2"), n.alias("p3")).alias("ord")
    seconds = F.format_string("%.9g", F.col("sum_ns") / 1e9)
    seconds = F.regexp_replace(F.regexp_replace(seconds, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    lines = ranked(buckets.select(*by, "le", "cumulative_count")).select("node_id", order(0, bound), F.concat(F.lit(f"{name}_bucket{{"), inner, F.lit('le="'), F.col("le"), F.lit('"} '), F.col("cumulative_count").cast("string")).alias("line"))
    both = ranked(totals.select(*by, "sum_ns", "count"))
    sums = both.select("node_id", order(1, F.lit(0.0)), F.concat(F.lit(f"{name}_sum"), braces, F.lit(" "), seconds).alias("line"))
    counts = both.select("node_id", order(2, F.lit(0.0)), F.concat(F.lit(f"{name}_count"), braces, F.lit(" "), F.col("count").cast("string")).alias("line"))
    return lines.unionByName(sums).unionByName(counts)
