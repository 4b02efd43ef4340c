"""Protocol handlers as folds over recorded facts: a call and a node's state give the answer and the node's next state.

A handler is a projection where its node's state is a row; the log part of an append is a join and an aggregation by call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import ENTRY_HEADER, JOINT, MAX_BYTES, MAX_ENTRIES, MAX_QUEUED, MAX_QUEUED_BYTES, STABLE
from . import log_ops, quorum


def append_answers(calls: DataFrame, entries: DataFrame, local: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each append call gets from the node that it is sent to; every call meets the node as it is recorded.

    `calls` (call, node_id, term, prev_log_index, prev_log_term, leader_commit); `entries` (call, log_index, term), which
    follow on prev_log_index; `local` (node_id, log_index, term); `nodes` (node_id, current_term, role, commit_index,
    base_index, base_term, last_index). Result: (call, node_id, answer_term, success, match_index, truncate_from,
    commit_index, role): an older term is refused; the entry before must be there; from the first entry that is missing or
    of another term the log is replaced; the commit index follows the leader's up to the end of the node's new log.
    """
    head = calls.join(nodes, "node_id")
    stale = F.col("term") < F.col("current_term")
    prev = local.select("node_id", F.col("log_index").alias("prev_log_index"), F.col("term").alias("__prev"))
    met = head.join(prev, ["node_id", "prev_log_index"], "left")
    known = F.when(F.col("prev_log_index") == F.col("base_index"), F.col("base_term")).when(F.col("prev_log_index") > F.col("base_index"), F.col("__prev"))
    agrees = ~stale & F.coalesce(known == F.col("prev_log_term"), F.lit(False))
    own = local.select("node_id", "log_index", F.col("term").alias("__term"))
    sent = entries.join(calls.select("call", "node_id"), "call").join(own, ["node_id", "log_index"], "left")
    per = sent.groupBy("call").agg(F.count("*").alias("__n"), F.min(F.when(F.col("__term").isNull() | (F.col("__term") != F.col("term")), F.col("log_index"))).alias("__from"))
    full = met.withColumn("__good", agrees).withColumn("__stale", stale).join(per, "call", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    end = F.col("prev_log_index") + F.col("__n")
    last = F.when(F.col("__from").isNotNull(), end).otherwise(F.col("last_index"))
    commit = quorum.follower_commit(F.col("commit_index"), F.col("leader_commit"), last)
    return full.select(
        "call",
        "node_id",
        F.greatest("term", "current_term").alias("answer_term"),
        F.col("__good").alias("success"),
        F.when(F.col("__good"), end).otherwise(0).alias("match_index"),
        F.when(F.col("__good"), F.col("__from")).alias("truncate_from"),
        F.when(F.col("__good"), commit).otherwise(F.col("commit_index")).alias("commit_index"),
        F.when(F.col("__stale"), F.col("role")).otherwise("follower").alias("role"),
    )


def pre_vote(requests: DataFrame) -> DataFrame:
    """Add `granted` to hypothetical votes (prospective_term, candidate_id, last_term, last_index) beside the voter's state.

    The state: current_term, role, now_us, contact_us, voters (array), node_id, log_last_term, log_last_index. Nothing is
    granted for a term that isn't ahead, after recent contact with a leader, or between nodes that don't both vote.
    """
    heard = quorum.recent_contact(F.col("role"), F.col("now_us"), F.col("contact_us"))
    members = F.array_contains("voters", F.col("candidate_id")) & F.array_contains("voters", F.col("node_id"))
    fresh = log_ops.up_to_date(F.col("last_term"), F.col("last_index"), F.col("log_last_term"), F.col("log_last_index"))
    return requests.withColumn("granted", (F.col("prospective_term") > F.col("current_term")) & ~heard & members & fresh)


def replication_calls(peers: DataFrame, log: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The next append call to every peer (node_id, next_index): prev_log_index, entries, logical_bytes, needs_snapshot.

    `log` (log_index, term, command) starts behind its base index. A peer's range starts at its next index and is bounded
    by entries and encoded bytes, the first entry going always; a peer behind the log's start needs a snapshot.
    """
    first = F.broadcast(log.agg(F.min("log_index").alias("__first")))
    due = peers.crossJoin(first).withColumn("next_index", F.greatest("next_index", F.lit(1))).withColumn("needs_snapshot", F.coalesce((F.col("__first") > 1) & (F.col("next_index") < F.col("__first")), F.lit(False)))
    # A range has at most max_entries indexes, so the join is by equality on them and its size is bounded.
    wanted = due.filter(~F.col("needs_snapshot")).select("node_id", "next_index", F.explode(F.sequence(F.col("next_index"), F.col("next_index") + (max_entries - 1))).alias("log_index"))
    sizes = log.select("log_index", F.octet_length("command").cast("bigint").alias("__size"))
    met = wanted.join(sizes, "log_index")
    to = F.sum(F.col("__size") + ENTRY_HEADER).over(W.partitionBy("node_id").orderBy("log_index").rowsBetween(W.unboundedPreceding, 0))
    sent = met.withColumn("__to", to).filter((F.col("__to") <= max_bytes) | (F.col("log_index") == F.col("next_index")))
    per = sent.groupBy("node_id").agg(F.count("*").alias("entries"), F.sum("__size").alias("logical_bytes"))
    out = due.join(per, "node_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("node_id", F.when(~F.col("needs_snapshot"), F.col("next_index") - 1).alias("prev_log_index"), zero("entries"), zero("logical_bytes"), "needs_snapshot")


def replication_advance(sent: DataFrame) -> DataFrame:
    """Match and next index after an answer: rows with match_index, next_index, generation (now), sent_generation, term
    (now), sent_term, role, prev_log_index, entries, resp_term, success. Answers of another term or generation change
    nothing; a later term ends leadership; a mismatch steps back by one and starts a new generation."""
    later = F.col("resp_term") > F.col("term")
    live = ~later & (F.col("role") == "leader") & (F.col("term") == F.col("sent_term")) & (F.col("generation") == F.col("sent_generation"))
    match = F.col("prev_log_index") + F.col("entries")
    ahead = live & F.col("success") & (match > F.col("match_index"))
    back = live & ~F.col("success")
    return (
        sent.withColumn("action", F.when(later, "step_down").when(~live, "stale").when(F.col("success"), "advance").otherwise("back_off"))
        .withColumn("next_index", F.when(ahead, match + 1).when(back, F.greatest(F.col("next_index") - 1, F.lit(1))).otherwise(F.col("next_index")))
        .withColumn("match_index", F.when(ahead, match).otherwise(F.col("match_index")))
        .withColumn("generation", F.col("generation") + F.when(back, 1).otherwise(0))
    )


def transitions(facts: DataFrame, by: str = "node_id", order: str = "at") -> DataFrame:
    """Role and term changes of recorded node facts (node_id, at, role, term, voted_for): (..., change, vote_reset).

    change: step_down (a later term), follower (same term), leader, candidate; a later term always clears the vote.
    """
    w = W.partitionBy(by).orderBy(order)
    was = facts.withColumn("__role", F.lag("role").over(w)).withColumn("__term", F.lag("term").over(w))
    moved = was.filter(F.col("__role").isNotNull() & ((F.col("__role") != F.col("role")) | (F.col("__term") != F.col("term"))))
    up = F.col("term") > F.col("__term")
    change = F.when(up & (F.col("role") == "follower"), "step_down").otherwise(F.col("role"))
    return moved.withColumn("change", change).withColumn("vote_reset", up).drop("__role", "__term")


def membership_changes(requests: DataFrame, base_index: int = 0) -> DataFrame:
    """The log rows of voter changes (arrival, role, mode, transfer, old: map, new: map): a joint entry and, after it, a stable one.

    Result: (arrival, status, log_index, mode, voters, old_voters): one row with a status and no entry for a refused
    request, two rows for an accepted one. Entries are numbered in order of arrival.
    """
    status = F.when(F.col("role") != "leader", "NOT_LEADER").when(F.col("mode") == JOINT, "MEMBERSHIP_CHANGE_IN_PROGRESS").when(F.col("transfer"), "LEADERSHIP_TRANSFER_IN_PROGRESS").when(~quorum.valid_configuration(F.col("new")), "INVALID_CONFIGURATION").otherwise("OK")
    judged = requests.withColumn("status", status)
    good = log_ops.assigned(judged.filter("status = 'OK'"), 0, 0, "arrival").drop("term").withColumnRenamed("log_index", "__n")
    rows = F.explode(F.array(F.struct(F.lit(0).alias("late"), F.lit(JOINT).alias("mode")), F.struct(F.lit(1).alias("late"), F.lit(STABLE).alias("mode")))).alias("x")
    index = F.lit(base_index) + 2 * F.col("__n") - 1 + F.col("x.late")
    voters = quorum.sorted_voters(F.col("new"))
    out = good.drop("mode").select("arrival", "status", "__n", "old", "new", rows).select("arrival", "status", index.alias("log_index"), F.col("x.mode").alias("mode"), voters.alias("voters"), F.when(F.col("x.late") == 0, quorum.sorted_voters(F.col("old"))).alias("old_voters"))
    kind = out.schema["voters"].dataType
    bad = judged.filter("status <> 'OK'").select("arrival", "status", F.lit(None).cast("bigint").alias("log_index"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast(kind).alias("voters"), F.lit(None).cast(kind).alias("old_voters"))
    return out.unionByName(bad)


def transfer_status(requests: DataFrame) -> DataFrame:
    """Add `status` to leadership transfers (role, mode, transfer, own_id, target, voters, match_index, last_index, accepted)."""
    status = (
        F.when(F.col("role") != "leader", "NOT_LEADER")
        .when(F.col("target") == F.col("own_id"), "CANNOT_TRANSFER_TO_SELF")
        .when(F.col("mode") == JOINT, "MEMBERSHIP_CHANGE_IN_PROGRESS")
        .when(F.col("transfer"), "LEADERSHIP_TRANSFER_IN_PROGRESS")
        .when(~F.array_contains("voters", F.col("target")), "NOT_A_VOTER")
        .when(~quorum.transfer_ready(F.col("match_index"), F.col("last_index")), "TIMEOUT")
        .when(~F.col("accepted"), "TRANSFER_REJECTED")
        .otherwise("OK")
    )
    return requests.withColumn("status", status)


def admitted(arrivals: DataFrame, most: int = MAX_QUEUED, most_bytes: int = MAX_QUEUED_BYTES, group: str = "node_id", order: str = "at") -> DataFrame:
    """Add `outcome` (ADMITTED, BUSY) to proposals (node_id, at, bytes, done_at), done_at being when one leaves the queue.

    Whether a proposal is admitted depends on all before it, so a node's arrivals are folded in order as a sorted stream that
    holds the queue, which the limits bound. At equal times what leaves goes first.
    """
    import heapq

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrivals.schema) + ", outcome string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queue, held = object(), [], 0
        for b in batches:
            out = []
            for g, at, size, until in zip(*(b.column(c).to_pylist() for c in (group, order, "bytes", "done_at")), strict=True):
                if g != now:
                    now, queue, held = g, [], 0
                while queue and queue[0][0] <= at:
                    held -= heapq.heappop(queue)[1]
                fits = len(queue) + 1 <= most and held + size <= most_bytes
                if fits:
                    heapq.heappush(queue, (until, size))
                    held += size
                out.append("ADMITTED" if fits else "BUSY")
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "outcome"])

    return arrivals.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def install_decisions(installs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add `action` to received snapshots (node_id, term, index): stale (an older term), ignored (already applied), installed."""
    met = installs.join(nodes.select("node_id", "current_term", "last_applied"), "node_id")
    action = F.when(F.col("term") < F.col("current_term"), "stale").when(F.col("index") <= F.col("last_applied"), "ignored").otherwise("installed")
    return met.withColumn("action", action).drop("current_term", "last_applied")


def chunks(data: bytes, most: int) -> list[tuple[int, bytes, bool]]:
    """(offset, data, done) of the pieces that a snapshot is sent in; an empty one is a single empty piece."""
    starts = np.arange(0, max(len(data), 1), most).tolist()
    return [(s, data[s : s + most], s + most >= len(data)) for s in starts]


def reassembled(pieces: DataFrame, by: tuple[str, ...] = ("transfer",)) -> DataFrame:
    """(by..., next_offset, complete) of received pieces (by..., offset, length, done): how far they are without a gap.

    Repeated pieces are fine. The first gap is found within a transfer, whose pieces its size bounds.
    """
    w = W.partitionBy(*by).orderBy("offset", "length")
    reach = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(W.unboundedPreceding, -1))
    seen = pieces.withColumn("__reach", F.coalesce(reach, F.lit(0)))
    gap = F.min(F.when(F.col("offset") > F.col("__reach"), F.col("__reach")))
    end = F.max(F.col("offset") + F.col("length"))
    per = seen.groupBy(*by).agg(gap.alias("__gap"), end.alias("__end"), F.max(F.when(F.col("done"), F.col("offset") + F.col("length"))).alias("__size"))
    reached = F.coalesce("__gap", "__end")
    return per.select(*by, reached.alias("next_offset"), F.coalesce(reached == F.col("__size"), F.lit(False)).alias("complete"))


def opened(nodes: DataFrame) -> DataFrame:
    """What a node recovers from its files (node_id, commit_index, base_index, last_index, snapshot_index): with `commit_index`
    raised to the snapshot, `replay_from`, `replay_to`, and `valid`: the commit index isn't behind the log's end."""
    snap = F.coalesce("snapshot_index", F.lit(0))
    commit = F.greatest("commit_index", snap)
    last = F.greatest("last_index", snap)
    return nodes.select("node_id", commit.alias("commit_index"), (snap + 1).alias("replay_from"), commit.alias("replay_to"), (commit <= last).alias("valid"))


def current_term_commit(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """(node_id, ready): whether a leader's commit index has an entry of its current term, which reads need.

    `nodes` (node_id, current_term, commit_index, base_index, base_term), `log` (node_id, log_index, term).
    """
    at = nodes.join(log.select("node_id", F.col("log_index").alias("commit_index"), F.col("term").alias("__term")), ["node_id", "commit_index"], "left")
    term = F.when(F.col("commit_index") == F.col("base_index"), F.col("base_term")).otherwise(F.col("__term"))
    return at.select("node_id", F.coalesce((F.col("commit_index") > 0) & (term == F.col("current_term")), F.lit(False)).alias("ready"))


def is_voter(nodes: DataFrame, memberships: DataFrame) -> DataFrame:
    """Add `voter`: whether the node is in a configuration (config, node_id) of the membership, the old or the new one."""
    own = memberships.select("node_id").distinct().withColumn("__in", F.lit(True))
    return nodes.join(own, "node_id", "left").withColumn("voter", F.col("__in").isNotNull()).drop("__in")


def first_time(samples: DataFrame, predicate: Column, by: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """(by..., first_ts): when a predicate first holds; null for a series in which it never does."""
    return samples.groupBy(*by).agg(F.min(F.when(predicate, F.col(ts))).alias("first_ts"))
