"""The registered queries over `events`, one or more for each operator family, and the facts they are derived from.

Protocol facts (matches, votes, memberships, scrapes) that no table holds are derived from event numbers, so that the
same rows can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import be, decode_command, encode_command, fingerprint, text_fingerprint
from ..operators import evidence, log_ops, metrics, promql, quorum, state
from . import events as ev

Query = Callable[[SparkSession, str], DataFrame]

READ_INDEX, BOUNDARY = 5000, 6000
#: Five nodes vote in the stable examples; the joint ones go from nodes 1-3 to nodes 2-5.
NODES = 5


def _events(s: SparkSession, d: str) -> DataFrame:
    return ev.events(s, d)


def _log(s: SparkSession, d: str) -> DataFrame:
    return ev.clean_log(_events(s, d))


def _anomalies(s: SparkSession, d: str) -> DataFrame:
    return ev.anomaly_log(_events(s, d))


def ag1_lww_state(s, d):
    return state.live(_log(s, d)).select("k", "v", "log_index")


def ag1_lww_anomaly_state(s, d):
    return state.live(_anomalies(s, d)).select("k", "v", "log_index")


def ag2_dedup_outcomes(s, d):
    return state.classify(_anomalies(s, d)).groupBy("outcome").agg(F.count("*").alias("commands"))


def ag2_classified_log(s, d):
    return state.classify(_anomalies(s, d)).select("log_index", "client_id", "seq", "outcome")


def ag2_identified_state(s, d):
    return state.identified_state(_anomalies(s, d)).select("k", "v", "log_index")


def d5_client_records(s, d):
    return state.client_records(_anomalies(s, d)).select("client_id", "last_seq", "last_fingerprint", "last_result")


def pr13_lookup(s, d):
    """What a retry of every client's second last request, and its next request, would be."""
    records = state.client_records(_anomalies(s, d))
    retry = records.select("client_id", F.explode(F.sequence(F.col("last_seq") - 1, F.col("last_seq") + 2)).alias("seq"), F.col("last_fingerprint").alias("fp"))
    return state.lookup(retry, records).select("client_id", "seq", "outcome")


def jn17_single_flight(s, d):
    return state.single_flight(_anomalies(s, d)).select("client_id", "seq", "waiters", "outcome")


def pr1_point_reads(s, d):
    keys = s.range(0, 120).select(F.col("id").cast("string").alias("k"))
    return state.get(state.live(_log(s, d)).select("k", "v"), keys).select("k", "v", "status")


def pr2_get_at_index(s, d):
    keys = s.range(0, 120).select(F.col("id").cast("string").alias("k"))
    return state.get_at(_log(s, d), keys, READ_INDEX).select("k", "v", "status")


def pr3_committed_prefix(s, d):
    return state.committed(_log(s, d), 100, 900).select("log_index", "k", "op", "v")


def pr6_entries_range(s, d):
    size = F.length("k") + F.coalesce(F.length(F.col("v").cast("string")), F.lit(0)) + 13
    return log_ops.entries_range(_log(s, d), 100, 64, 500, size).select("log_index", "k", "v")


def _terms(log: DataFrame) -> DataFrame:
    """Entries with terms that rise every 512 indexes; every 97th is a no-op."""
    return log.select("log_index", (F.floor(F.col("log_index") / 512) + 1).alias("term"), F.when(F.col("log_index") % 97 == 0, 1).otherwise(0).alias("kind"), "k", "v")


def _incoming(log: DataFrame) -> DataFrame:
    """A leader's entries for the whole log, all with values of their own; terms differ from index 800 on."""
    return _terms(log).withColumn("term", F.when(F.col("log_index") >= 800, F.col("term") + 3).otherwise(F.col("term"))).withColumn("v", F.coalesce(F.col("v"), F.lit(0)) + 7)


def jn3_first_conflict(s, d):
    return log_ops.first_conflict(_incoming(_log(s, d)), _terms(_log(s, d)))


def se5_conflict_repair(s, d):
    return log_ops.repaired(_terms(_log(s, d)), _incoming(_log(s, d))).select("log_index", "term", "kind", "k", "v")


def jn5_range_equality(s, d):
    """The whole log against itself, itself without its last entry, and itself with another value in its last entry."""
    own = _terms(_log(s, d))
    last = F.broadcast(own.agg(F.max("log_index").alias("last")))
    marked = own.crossJoin(last)
    others = {
        "equal": own,
        "shorter": marked.filter("log_index < last"),
        "changed": marked.withColumn("v", F.when(F.col("log_index") == F.col("last"), F.coalesce(F.col("v"), F.lit(0)) + 1).otherwise(F.col("v"))),
    }
    per = [log_ops.same_entries(own, other, ("term", "kind", "k", "v")).select(F.lit(pair).alias("pair"), "same") for pair, other in others.items()]
    return per[0].unionByName(per[1]).unionByName(per[2])


def se6_compaction(s, d):
    return log_ops.compacted(_terms(_log(s, d)), 600).select("log_index", "term", "kind")


def se7_install_boundary(s, d):
    log = _terms(_log(s, d))
    kept = log_ops.installed(log, 600, 2).agg(F.lit("matching").alias("boundary"), F.count("*").alias("entries"))
    dropped = log_ops.installed(log, 600, 9).agg(F.lit("other term").alias("boundary"), F.count("*").alias("entries"))
    return kept.unionByName(dropped)


def se6_snapshot_suffix(s, d):
    log = _log(s, d)
    return state.restored(state.snapshot(log, BOUNDARY), log, BOUNDARY).select("k", "v", "log_index")


def pr8_term_at(s, d):
    wanted = s.range(590, 1200, 30).select(F.col("id").alias("log_index"))
    return log_ops.term_at(_terms(_log(s, d)), wanted, base_index=650, base_term=2).select("log_index", F.col("term").cast("bigint").alias("term"))


def jn9_waiters(s, d):
    """A waiter at every index; those at odd ones wait for another term."""
    log = _terms(_log(s, d))
    waiting = log.select("log_index", (F.col("term") + F.col("log_index") % 2).alias("term"))
    return log_ops.waited(waiting, log.withColumn("outcome", F.lit("APPLIED"))).select("log_index", "term", "outcome")


def wn2_gap_detection(s, d):
    """Segments of 64 indexes; every 11th starts three late, every 13th two early."""
    log = _log(s, d)
    base = log.groupBy(F.floor((F.col("log_index") - 1) / 64).alias("n")).agg(F.min("log_index").alias("m"), F.count("*").alias("entries"))
    shift = F.when(F.col("n") % 11 == 10, 3).when(F.col("n") % 13 == 12, -2).otherwise(0)
    return log_ops.gaps(base.select((F.col("m") + shift).alias("start_index"), "entries")).select("start_index", "entries")


def wn1_assigned_indexes(s, d):
    return log_ops.assigned(_events(s, d).select("event_id", "user_id"), 1000, 4, "event_id").select("event_id", "log_index", "term")


def ag24_batches(s, d):
    rows = _events(s, d).select((F.col("user_id") % 8).alias("node_id"), F.col("event_id").alias("arrival"), (F.col("event_id") % 700 + 50).alias("bytes"))
    return state.batch_ids(rows, 16, 4096).groupBy("node_id", "batch").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


def ag25_encoded_sizes(s, d):
    log = _log(s, d).withColumn("command", F.coalesce(F.col("v").cast("string"), F.lit("")).cast("binary"))
    return log_ops.encoded_bytes(log, by=("op",)).select("op", "entries", "bytes", "logical_bytes")


def _matches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """For every event a leader's view: its last index and what each of five nodes matches."""
    e = _events(s, d).select(F.col("event_id").alias("leader_key"), (F.col("event_id") % 5 + 1).alias("leader_id"), (F.col("event_id") % 800 + 200).alias("last_index"))
    nodes = F.explode(F.sequence(F.lit(1), F.lit(NODES))).alias("node_id")
    m = e.select("leader_key", "leader_id", nodes, "last_index").filter("node_id <> leader_id and (leader_key + node_id) % 7 <> 0")
    return e, m.select("leader_key", F.col("node_id").cast("bigint").alias("node_id"), F.greatest(F.lit(0), F.col("last_index") - (F.col("leader_key") * F.col("node_id")) % 211).alias("match_index"))


def ag6_commit_index(s, d):
    e, m = _matches(s, d)
    # Keyed by the view: each view's own node gets the view's id, as the operator wants self and leader to be one id.
    own = e.select(F.col("leader_key").alias("view"), "leader_id", "last_index")
    leaders = own.select(F.col("view").alias("leader_id"), F.lit(2).cast("bigint").alias("current_term"), F.lit(300).cast("bigint").alias("commit_index"), "last_index")
    old = F.array(*[F.struct(F.lit("old").alias("config"), F.lit(i).cast("bigint").alias("n")) for i in (1, 2, 3)])
    new = F.array(*[F.struct(F.lit("new").alias("config"), F.lit(i).cast("bigint").alias("n")) for i in (2, 3, 4, 5)])
    stable = F.array(*[F.struct(F.lit("old").alias("config"), F.lit(i).cast("bigint").alias("n")) for i in range(1, 6)])
    name = lambda n: F.when(n == F.col("leader_id"), F.col("view")).otherwise(-n)
    voters = own.select("view", "leader_id", F.explode(F.when(F.col("view") % 2 == 0, stable).otherwise(F.concat(old, new))).alias("x"))
    voters = voters.select(F.col("view").alias("leader_id"), "x.config", name(F.col("x.n")).alias("node_id"))
    matches = m.select(F.col("leader_key").alias("leader_id"), (-F.col("node_id")).alias("node_id"), "match_index")
    log = _log(s, d).select("log_index", F.when(F.col("log_index") < 500, 1).otherwise(2).cast("bigint").alias("term"))
    return quorum.commit_index(voters, matches, log, leaders).select(F.col("leader_id").alias("view"), "commit_index")


def ag4_quorum(s, d):
    acks = _events(s, d).select(F.floor(F.col("event_id") / 4).alias("round"), (F.col("event_id") * 7 % 6 + 1).alias("node_id"))
    rounds = acks.select("round").distinct()
    voters = rounds.select("round", F.lit("stable").alias("config"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(NODES).cast("bigint"))).alias("node_id"))
    return quorum.quorum(voters, acks, ("round",)).select("round", "has_quorum")


def ag5_joint_quorum(s, d):
    acks = _events(s, d).select(F.floor(F.col("event_id") / 5).alias("round"), (F.col("event_id") * 11 % 7 + 1).alias("node_id"))
    rounds = acks.select("round").distinct()
    configs = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(n).cast("bigint").alias("node_id")) for c, ns in (("old", (1, 2, 3)), ("new", (2, 3, 4, 5))) for n in ns])).alias("x")
    voters = rounds.select("round", configs).select("round", "x.config", "x.node_id")
    return quorum.quorum(voters, acks, ("round",)).select("round", "has_quorum")


def ag8_membership(s, d):
    """Each user is a node; its 'signup' events are joint entries, its 'purchase' events stable ones."""
    e = _events(s, d)
    entries = e.filter("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("node_id"), (F.col("event_id") + 1).alias("log_index"), F.when(F.col("event_type") == "signup", 2).otherwise(1).alias("mode"))
    commits = e.groupBy(F.col("user_id").alias("node_id")).agg((F.max("event_id") - F.col("user_id") % 40 * 20).alias("commit_index"))
    return quorum.effective_membership(entries, commits).select("node_id", "log_index", "mode", "pending_stable")


def ag9_vote_tally(s, d):
    e = _events(s, d)
    votes = e.select(F.floor(F.col("event_id") / 6).alias("term"), (F.col("event_id") % 2).alias("candidate_id"), (F.col("event_id") * 13 % 7 + 1).alias("voter_id"), (F.col("event_type") != "error").alias("granted"))
    rows = s.range(1, 6).select(F.lit("stable").alias("config"), F.col("id").alias("node_id"))
    return quorum.tally(votes, rows).select("term", "candidate_id", "granted", "has_quorum")


def ct7_vote_decisions(s, d):
    e = _events(s, d)
    requests = e.select((F.col("user_id") % 5).alias("node_id"), F.floor(F.col("event_id") / 20).alias("term"), (F.col("event_id") % 3).alias("candidate_id"), (F.col("event_id") % 4).alias("last_term"), (F.col("event_id") % 50).alias("last_index"), F.col("event_id").alias("arrival"))
    nodes = s.range(0, 5).select(F.col("id").alias("node_id"), F.lit(2).alias("log_last_term"), (F.col("id") * 10).alias("log_last_index"))
    return quorum.vote_decisions(requests, nodes).select("arrival", "node_id", "term", "candidate_id", "granted")


def pr10_log_up_to_date(s, d):
    e = _events(s, d)
    return e.select("event_id", quorum_fresh().alias("up_to_date"))


def quorum_fresh():
    i = F.col("event_id")
    return log_ops.up_to_date(i % 5, i % 17, i % 4, i % 13)


def st20_read_index(s, d):
    e = _events(s, d)
    probes = e.select(F.floor(F.col("event_id") / 8).alias("read_context"), F.lit(3).cast("bigint").alias("term"), (F.col("event_id") % 6 + 1).alias("node_id"), F.when(F.col("event_id") % 9 == 0, 2).otherwise(3).alias("resp_term"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.floor(F.col("event_id") / 8)).alias("resp_context"))
    voters = s.range(1, 6).select(F.lit("stable").alias("config"), F.col("id").alias("node_id"))
    return quorum.read_index_quorum(probes, voters).select("read_context", "has_quorum")


def _configurations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Old and new members of every change: 400 events each, the first half old members, all but the first quarter new ones."""
    e = _events(s, d).select(F.floor(F.col("event_id") / 400).alias("change"), (F.col("event_id") % 400).alias("i"), F.col("user_id").alias("node_id"))
    return e.filter("i < 200").select("change", "node_id").distinct(), e.filter("i >= 100").select("change", "node_id").distinct()


def se1_union_peers(s, d):
    old, new = _configurations(s, d)
    peers = quorum.union_peers(old.withColumn("addr", F.lit("a")), new.withColumn("addr", F.lit("b")), 7, by=("change",))
    return peers.select("change", "node_id", "addr")


def jn13_target_changes(s, d):
    return quorum.target_changes(*_configurations(s, d), by=("change",)).select("change", "node_id", "action")


def _observations(s: SparkSession, d: str) -> DataFrame:
    """Requests with labels, some of them unknown, and durations: the event's value in tens of microseconds."""
    e = _events(s, d)
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "scan").otherwise("put")
    status = F.when(F.col("event_id") % 11 == 0, "busy").when(F.col("event_id") % 13 == 0, "stale").when(F.col("event_id") % 7 == 0, "not_found").otherwise("ok")
    return e.select("event_id", "event_type", "user_id", op.alias("operation"), status.alias("status"), F.round(F.col("value") * 10_000).cast("bigint").alias("duration_ns"))


def ag10_requests_total(s, d):
    return metrics.requests_total(_observations(s, d)).select("operation", "status", "requests")


def ag12_histogram(s, d):
    obs = _observations(s, d)
    return metrics.histogram(obs, F.col("duration_ns") / 1e9, ("event_type",)).select("event_type", "le", "cumulative_count")


def ag12_histogram_totals(s, d):
    return metrics.histogram_totals(_observations(s, d), F.col("duration_ns"), ("event_type",)).select("event_type", "sum_ns", "count")


def ag13_counters(s, d):
    return metrics.counters(_observations(s, d), ("operation",), busy="status = 'busy'", failures="status not in ('ok', 'not_found')", slow="duration_ns > 3000000").select("operation", "busy", "failures", "slow")


def ag14_gauges(s, d):
    return metrics.gauges(_observations(s, d), "duration_ns", "event_id", ("user_id",)).select("user_id", "duration_ns")


def ag15_percentile_floor(s, d):
    return metrics.floor_percentiles(_observations(s, d), "duration_ns", ("event_type",)).select("event_type", "n", "p50", "p95", "p99")


def ag16_write_amplification(s, d):
    obs = _observations(s, d).select("event_type", (F.length("operation") + F.col("event_id") % 100).alias("logical"), (F.length("operation") + F.col("event_id") % 100 + 25).alias("physical"))
    out = metrics.write_amplification(obs, "physical", "logical", ("event_type",))
    return out.select("event_type", "physical_bytes", "logical_bytes", F.round("amplification", 6).alias("amplification"))


def ag19_high_water(s, d):
    moves = _events(s, d).select((F.col("user_id") % 10).alias("node_id"), F.col("event_id").alias("ts"), F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(-1).alias("delta"))
    return metrics.high_water(moves).select("node_id", "high_water")


def wn4_lags(s, d):
    i = F.col("event_id")
    return _events(s, d).select("event_id", metrics.apply_lag(i % 100, i % 70).alias("apply_lag"), metrics.peer_lag(i % 90, i % 110).alias("peer_lag"))


def wn6_role_changes(s, d):
    rows = _events(s, d).select("user_id", "event_id", F.col("event_type").alias("role"))
    return metrics.changes(rows, "role", ("user_id",), "event_id").select("user_id", "event_id", "previous", "role")


def _counter(s: SparkSession, d: str) -> DataFrame:
    """A counter of each user's node, reset every 1000 events."""
    e = _events(s, d)
    return e.select((F.col("user_id") % 20).alias("node_id"), promql.epoch("ts").alias("ts"), "event_id", (F.col("event_id") % 1000).alias("value"))


def wn9_counter_increases(s, d):
    return promql.increases(_counter(s, d), ("node_id",), "event_id").select("node_id", "event_id", "increase")


def wn10_histogram_quantile(s, d):
    b = metrics.histogram(_observations(s, d), F.col("duration_ns") / 1e9, ("event_type",))
    b = b.withColumn("bound", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double")))
    return promql.quantile(b, 0.95, ("event_type",), "bound").select("event_type", F.round("quantile", 9).alias("quantile"))


def wn11_sustained_alert(s, d):
    # Events of one second go by their exact time and their number, wherever they are stored.
    e = _events(s, d).select("user_id", promql.epoch("ts").alias("ts"), F.col("ts").alias("at"), "event_id", "value")
    return promql.sustained(e, F.col("value") > 20, 20_000, ("user_id",), ties=("at", "event_id")).select("user_id", "started", "ended", "fires_at")


def wn12_instant_max(s, d):
    e = _events(s, d).select((F.floor(promql.epoch("ts") / 3600) * 3600).alias("ts"), (F.col("event_id") % 37).alias("value"), "event_type")
    return promql.instant(e, "max", ("event_type",)).select("ts", "event_type", "value")


def _puts(s: SparkSession, d: str) -> DataFrame:
    """Every write, acknowledged."""
    log = _log(s, d).filter("op = 'PUT'")
    return log.select(F.concat_ws("-", "client_id", "k").alias("key"), F.col("v").cast("string").alias("value"), "log_index", F.when(F.col("log_index") <= BOUNDARY, "before").otherwise("after").alias("phase"))


def _key_state(s: SparkSession, d: str) -> DataFrame:
    log = _log(s, d).select(F.concat_ws("-", "client_id", "k").alias("key"), "op", F.col("v").cast("string").alias("value"), "log_index")
    return state.live(log, "key", "value").select("key", "value")


def jn2_ack_verification(s, d):
    return evidence.verification(_puts(s, d), _key_state(s, d))


def jn2_verified_writes(s, d):
    return evidence.verified(_puts(s, d), _key_state(s, d)).select("key", "value", "phase", "log_index", "verified")


def ag23_ack_phases(s, d):
    return evidence.ack_phases(_puts(s, d))


def jn15_missing_events(s, d):
    wanted = s.createDataFrame([(x,) for x in ("click", "view", "logout", "refund")], "event_type string")
    return evidence.missing(wanted, _events(s, d), "event_type")


def fn1_fingerprint(s, d):
    return _log(s, d).select("log_index", text_fingerprint(F.col("op"), F.col("k"), F.col("v")).alias("fp"))


def fn1_binary_fingerprint(s, d):
    log = _log(s, d)
    op = F.when(F.col("op") == "PUT", 1).otherwise(2)
    return log.select("log_index", fingerprint(op, F.col("k").cast("binary"), F.col("v").cast("string").cast("binary")).alias("fp"))


def fn4_command_codec(s, d):
    """Every command encoded, with its bytes in hex, and decoded again."""
    log = ev.identified(_events(s, d))
    op = F.when(F.col("op") == "PUT", 1).otherwise(2)
    ident = F.when(F.col("client_id") % 3 != 0, F.concat(be(F.col("client_id") + 1, 8), be(F.lit(0), 8)))
    raw = log.select("event_id", encode_command(op, F.col("k").cast("binary"), F.col("v").cast("string").cast("binary"), ident, F.col("seq")).alias("b"))
    c = raw.select("event_id", F.lower(F.hex("b")).alias("encoded"), decode_command(F.col("b")).alias("c"))
    return c.select("event_id", "encoded", "c.error", F.col("c.op").cast("int").alias("op"), F.col("c.seq").cast("bigint").alias("seq"), F.col("c.key").cast("string").alias("key"), F.col("c.value").cast("string").alias("value"))


def queries() -> dict[str, Query]:
    skip = {"quorum_fresh", "queries"}
    return {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in skip and getattr(v, "__module__", "") == __name__}
