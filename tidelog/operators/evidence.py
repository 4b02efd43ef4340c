"""Verifying recorded evidence: acknowledged writes against final state, bundles, checksums, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .. import schemas


def verified(acks: DataFrame, state: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Every acknowledged write with `verified`: whether the final state has its value."""
    own = state.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    met = acks.join(own, F.col(key) == F.col("__k"), "left")
    return met.withColumn("verified", F.col("__k").isNotNull() & F.col(value).eqNullSafe(F.col("__v"))).drop("__k", "__v")


def verification(acks: DataFrame, state: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: total_acknowledged, verified_acknowledged, verification_missing."""
    n = F.count("*")
    ok = F.count_if("verified")
    return verified(acks, state, key, value).agg(n.alias("total_acknowledged"), ok.alias("verified_acknowledged"), (n - ok).alias("verification_missing"))


def ack_phases(acks: DataFrame) -> DataFrame:
    return acks.groupBy("phase").agg(F.count("*").alias("acknowledged"))


def missing(required: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    return required.join(seen.select(on).distinct(), on, "left_anti")


def checksum_mismatches(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, digest, actual) of listed files that are missing or differ. `files`: (path, content)."""
    own = files.select(F.col("path").alias("__p"), F.sha2("content", 256).alias("actual"))
    met = listed.join(own, F.col("path") == F.col("__p"), "left").drop("__p")
    return met.filter(F.col("actual").isNull() | (F.col("actual") != F.col("digest")))


def checksums(lines: DataFrame) -> DataFrame:
    """(digest, path) of checksum lines (value): a digest, two spaces, a path."""
    parts = F.split("value", "  ", 2)
    return lines.filter(F.col("value") != "").select(parts[0].alias("digest"), parts[1].alias("path"))


STATUS_FIELDS = {
    "node": ("node", "bigint"),
    "role": ("role", "string"),
    "term": ("term", "bigint"),
    "last-log-index": ("last_log_index", "bigint"),
    "commit-index": ("commit_index", "bigint"),
    "last-applied": ("last_applied", "bigint"),
    "apply-lag": ("apply_lag", "bigint"),
    "snapshot-index": ("snapshot_index", "bigint"),
    "snapshot-term": ("snapshot_term", "bigint"),
    "membership": ("membership", "string"),
}


def parse_status(texts: DataFrame, column: str = "value") -> DataFrame:
    """The status record of each status print: one `name: value` a line, then indented voters. `leader: unknown` is null."""
    t = F.col(column)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(t, rf"(?m)^[ \t]*{name}:[ \t]*(.*?)[ \t]*$", 1)), F.lit(""))
    leader = field("leader")
    voters = F.when(field("membership") == "stable", F.transform(F.regexp_extract_all(F.regexp_replace(t, r"(?s)^.*?membership:", ""), F.lit(r"(?m)^[ \t]*([0-9]+)[ \t]+127\.0\.0\.1:[0-9]+[ \t]*$"), F.lit(1)), lambda v: v.cast("bigint")))
    return texts.select(
        "*",
        F.lit(True).alias("reachable"),
        *[field(k).cast(kind).alias(name) for k, (name, kind) in STATUS_FIELDS.items()],
        F.when(leader != "unknown", leader).cast("bigint").alias("leader"),
        F.nullif(F.array_sort(voters), F.array().cast("array<bigint>")).alias("voters"),
    )


EVENTS = ("node_started", "election_started", "leader_elected", "dedup_stale", "raft_log_migrated")


def relevant_log(lines: DataFrame, redactions: dict[str, str] | None = None, most: int = 120, by: str = "node_id", order: str = "line_no") -> DataFrame:
    """The last `most` lines of each node with a listed event, paths replaced."""
    pick = None
    for e in EVENTS:
        hit = F.contains(F.col("value"), F.lit(f'"event":"{e}"'))
        pick = hit if pick is None else pick | hit
    text = F.col("value")
    for was, now in (redactions or {}).items():
        text = F.replace(text, F.lit(was), F.lit(now))
    kept = lines.filter(pick).withColumn("value", text)
    return tail(kept, most, by, order)


def status_rows(spark: SparkSession, path: str) -> DataFrame:
    """(node_key, status fields) of a status map file."""
    one = spark.read.text(path, wholetext=True)
    parsed = one.select(F.from_json("value", f"map<string,{T.StructType.fromDDL(schemas.NODE_STATUS).simpleString()}>").alias("m"))
    return parsed.select(F.explode("m").alias("node_key", "s")).select("node_key", "s.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: The events of a complete bundle, and text that none of its files may hold.
REQUIRED_EVENTS = ("cluster_ready", "load_started", "leader_crashed", "replacement_leader", "post_failover_progress", "old_leader_restarted", "old_leader_caught_up", "acknowledged_writes_verified")
FORBIDDEN = r"(?i)/(?:home|tmp|var|Users)/|[A-Za-z]:\\|hostname|ssh|MAC"


def leader_of(status: DataFrame) -> DataFrame:
    """The first leader by node: (node_key, term)."""
    return status.filter("role = 'leader'").orderBy(F.col("node_key").cast("bigint")).limit(1).select("node_key", "term")


def converged(status: DataFrame, voters: int = 3) -> DataFrame:
    """One row: one_leader, all_converged."""
    good = F.coalesce(F.col("reachable") & (F.col("membership") == "stable") & (F.col("apply_lag") == 0) & (F.size("voters") == voters), F.lit(False))
    return status.agg((F.count_if(F.col("reachable") & (F.col("role") == "leader")) == 1).alias("one_leader"), F.bool_and(good).alias("all_converged"))


def caught_up(status: DataFrame, restarted: str) -> DataFrame:
    """One row: whether the restarted node has applied what the most advanced survivor has committed."""
    return status.agg((F.max(F.when(F.col("node_key") == restarted, F.col("last_applied"))) >= F.max(F.when(F.col("node_key") != restarted, F.col("commit_index")))).alias("caught_up"))


def bundle_checks(spark: SparkSession, root: str) -> DataFrame:
    """(check, passed) for every rule of an evidence bundle, each from the bundle's small files."""
    manifest = read_json(spark, f"{root}/manifest.json", schemas.MANIFEST)
    workload = read_json(spark, f"{root}/workload-summary.json", schemas.WORKLOAD)
    ack = read_json(spark, f"{root}/acknowledged-writes-summary.json", schemas.ACK_SUMMARY)
    timeline = read_json(spark, f"{root}/timeline.json", schemas.TIMELINE)
    initial, failover, final = (status_rows(spark, f"{root}/{n}-status.json") for n in ("initial", "failover", "final"))
    m = manifest.select(F.struct("*").alias("m"))
    pack = lambda d, n: d.agg(F.map_from_entries(F.collect_list(F.struct("node_key", F.struct("*")))).alias(n))
    w, a = workload.select(F.struct("*").alias("w")), ack.select(F.struct("*").alias("a"))
    seen = timeline.agg(F.collect_set("event").alias("seen"))
    all_ = m.join(w).join(a).join(pack(initial, "i")).join(pack(failover, "f")).join(pack(final, "z")).join(seen)
    crashed, new = F.col("m.failure.leader_id"), F.col("m.recovery.replacement_leader_id")
    at = lambda c, k: F.try_element_at(F.col(c), k.cast("string"))
    values = F.map_values("z")
    live_leader = F.size(F.filter(values, lambda s: s["reachable"] & (s["role"] == "leader")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    rules = {
        "schema_version": F.col("m.schema_version") == 1,
        "scenario": F.col("m.scenario") == "leader_failover_under_load",
        "cluster": (F.col("m.cluster.nodes") == 3) & (F.col("m.cluster.transport") == "tcp") & (F.col("m.cluster.persistence") == "disk"),
        "workload_shape": (F.col("m.workload.workers") == 16) & (F.col("m.workload.put_percent") == 70) & (F.col("m.workload.get_percent") == 30),
        "failure_method": F.col("m.failure.method") == "SIGKILL",
        "distinct_replacement": crashed != new,
        "crashed_was_leader": at("i", crashed)["role"] == "leader",
        "replacement_leads": (at("f", new)["role"] == "leader") & (at("f", new)["term"] >= at("i", crashed)["term"]),
        "crashed_is_down": ~at("f", crashed)["reachable"],
        "no_protocol_errors": zero("w.stale_requests") & zero("w.request_conflicts") & zero("w.unexpected_protocol_errors"),
        "acknowledged_both_phases": (F.col("w.acknowledged_before") > 0) & (F.col("w.acknowledged_after") > 0),
        "all_verified": (F.col("a.total_acknowledged") == F.col("a.verified_acknowledged")) & (F.col("a.verification_missing") == 0),
        "manifest_agrees": F.col("m.result.verified_acknowledged_writes") == F.col("a.verified_acknowledged"),
        "one_final_leader": live_leader == 1,
        "all_converged": ~F.exists(values, lambda s: ~F.coalesce(s["reachable"] & (s["membership"] == "stable") & (s["apply_lag"] == 0) & (F.size(s["voters"]) == 3), F.lit(False))),
        "restarted_reachable": at("z", F.col("m.recovery.restarted_node_id"))["reachable"],
        "same_data_directory": F.col("m.recovery.same_data_directory"),
        "required_events": F.size(F.array_except(F.array(*[F.lit(e) for e in REQUIRED_EVENTS]), "seen")) == 0,
    }
    checks = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in rules.items()])).alias("x")
    own = all_.select(checks).select("x.check", "x.passed")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # The bundle's folder name cuts the reader's absolute paths down to those of the checksum list.
    folder = root.rstrip("/").rpartition("/")[2]
    local = files.select(F.regexp_replace("path", rf"^.*/{folder}/", "").alias("path"), "content").filter("path != 'SHA256SUMS'")
    listed = checksums(spark.read.text(f"{root}/SHA256SUMS"))
    sums = checksum_mismatches(listed, local).agg(F.lit("checksums").alias("check"), (F.count("*") == 0).alias("passed"))
    words = local.agg(F.lit("no_forbidden_text").alias("check"), (F.count_if(F.col("content").cast("string").rlike(FORBIDDEN)) == 0).alias("passed"))
    return own.unionByName(sums).unionByName(words)


#: The status that is shown beside each event of a timeline, by the event's place in it.
CHECKPOINTS = ((0, "initial", "initial"), (2, "crash", None), (3, "failover", "failover"), (5, "restart-pending", None), (6, "final", "final"))


def checkpoints(timeline: DataFrame, order: str = "at_seconds", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `ordinal`, `mode` and `checkpoint` (null between checkpoints) to the events of one timeline, a handful of rows.

    Events of equal `order` go by `ties`.
    """
    out = timeline.withColumn("ordinal", F.row_number().over(W.orderBy(order, *ties)) - 1)
    mode, checkpoint = None, None
    for at, name, shown in reversed(CHECKPOINTS):
        here = F.col("ordinal") >= at
        mode = F.when(here, name) if mode is None else mode.when(here, name)
        checkpoint = F.when(here, F.lit(shown)) if checkpoint is None else checkpoint.when(here, F.lit(shown))
    return out.withColumn("mode", mode).withColumn("checkpoint", checkpoint)


def versioned(manifests: DataFrame, version: int = 1) -> DataFrame:
    """Manifests as they are; one of another schema version fails the query."""
    wrong = F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))))
    return manifests.filter(F.when(F.col("schema_version").eqNullSafe(F.lit(version)), True).otherwise(wrong.cast("boolean")))


def tail(lines: DataFrame, most: int = 120, by: str = "node_id", order: str = "line_no") -> DataFrame:
    """The last lines of each node."""
    n = F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))
    return lines.withColumn("__n", n).filter(F.col("__n") <= most).drop("__n")


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """The fields of structured log files, a line of JSON each, with the file (`source`); other lines are dropped."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("source"), F.from_json("value", schemas.EVENT_LOG).alias("e"))
    return lines.filter("e.event is not null").select("source", "e.*")
