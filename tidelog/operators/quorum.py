"""Quorums, commit indexes, memberships and votes over recorded protocol facts.

A configuration table has (config, node_id): one config is a stable membership, two ('old', 'new') a joint one.
Memberships have at most 31 voters a configuration, so their arrays are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import JOINT, MAX_ADDRESS, MAX_VOTERS, STABLE


def majority(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(n / 2) + 1


def quorum(voters: DataFrame, acked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether a majority of every configuration acknowledged: (by..., has_quorum).

    `voters` (by..., config, node_id), `acked` (by..., node_id). Acknowledgements of outsiders and repeated ones don't
    count. For a joint membership that is a majority of both configurations, never of their union.
    """
    own = [*by, "node_id"]
    met = voters.join(acked.select(*own).distinct().withColumn("__ack", F.lit(True)), own, "left")
    per = met.groupBy(*by, "config").agg((F.count("__ack") >= majority(F.count("*"))).alias("__ok"))
    return per.groupBy(*by).agg(F.bool_and("__ok").alias("has_quorum"))


def commit_index(voters: DataFrame, matches: DataFrame, log: DataFrame, leaders: DataFrame) -> DataFrame:
    """(leader_id, commit_index): the highest index of the current term that a quorum has, or the old commit index.

    `voters` (leader_id, config, node_id); `matches` (leader_id, node_id, match_index); `log` (log_index, term);
    `leaders` (leader_id, current_term, commit_index, last_index). A leader matches its own last index, a voter without a
    row matches 0. In a configuration of n voters the majority-th largest match is what a majority has; a joint
    membership takes the smaller of both. Terms never decrease along a log, so if that entry is of the current term it
    is the answer, and if its term is older nothing above the old index can be committed.
    """
    head = leaders.select("leader_id", "current_term", F.col("commit_index").alias("__old"), "last_index")
    known = matches.select("leader_id", "node_id", "match_index")
    met = voters.join(head, "leader_id").join(known, ["leader_id", "node_id"], "left")
    match = F.when(F.col("node_id") == F.col("leader_id"), F.col("last_index")).otherwise(F.least(F.coalesce("match_index", F.lit(0)), F.col("last_index")))
    sorted_ = F.sort_array(F.collect_list(match), asc=False)
    per = met.groupBy("leader_id", "config").agg(sorted_.alias("m")).select("leader_id", F.element_at("m", majority(F.size("m")).cast("int")).alias("n"))
    both = per.groupBy("leader_id").agg(F.min("n").alias("n")).join(head, "leader_id")
    at = both.join(log.select(F.col("log_index").alias("n"), "term"), "n", "left")
    good = (F.col("n") > F.col("__old")) & (F.col("term") == F.col("current_term"))
    return at.select("leader_id", F.when(good, F.col("n")).otherwise(F.col("__old")).alias("commit_index"))


def follower_commit(commit: Column, leader_commit: Column, last_index: Column) -> Column:
    """A follower's commit index: monotone, and bounded by its whole log (not by its last new entry)."""
    return F.greatest(commit, F.least(leader_commit, last_index))


def effective_membership(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """(node_id, log_index, mode, pending_stable) from configuration entries (node_id, log_index, mode).

    A joint membership is active from its append, a stable one only once it is committed. An uncommitted stable entry
    after the active one is pending. `commits`: (node_id, commit_index). Nodes without an active entry aren't returned:
    their bootstrap configuration holds.
    """
    met = entries.join(commits, "node_id")
    active = (F.col("mode") == JOINT) | (F.col("log_index") <= F.col("commit_index"))
    waiting = ~active
    per = met.groupBy("node_id").agg(F.max_by("mode", F.when(active, F.col("log_index"))).alias("mode"), F.max(F.when(active, F.col("log_index"))).alias("log_index"), F.max(F.when(waiting, F.col("log_index"))).alias("__late"))
    return per.filter("log_index is not null").select("node_id", "log_index", "mode", F.when(F.col("__late") > F.col("log_index"), F.col("__late")).alias("pending_stable"))


def tally(votes: DataFrame, voters: DataFrame, by: tuple[str, ...] = ("term", "candidate_id")) -> DataFrame:
    """(by..., granted, has_quorum): granted votes of distinct voters. `voters`: (config, node_id) for all terms."""
    granted = votes.filter("granted").select(*by, F.col("voter_id").alias("node_id")).distinct()
    per = granted.join(voters, "node_id").groupBy(*by, "config").agg(F.count("*").alias("n"))
    sizes = voters.groupBy("config").agg(majority(F.count("*")).alias("need"))
    won = per.join(sizes, "config").groupBy(*by).agg(F.count_if(F.col("n") >= F.col("need")).alias("ok"))
    counts = granted.join(voters.select("node_id").distinct(), "node_id", "left_semi").groupBy(*by).agg(F.count("*").alias("granted"))
    total = sizes.agg(F.count("*").alias("configs"))
    return counts.join(won, list(by), "left").crossJoin(F.broadcast(total)).select(*by, "granted", (F.coalesce("ok", F.lit(0)) == F.col("configs")).alias("has_quorum"))


def vote_decisions(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """One vote a term: of each node's requests in a term, the first eligible candidate and its repeats are granted.

    `requests` (node_id, term, candidate_id, last_term, last_index, arrival); `nodes` (node_id, log_last_term, log_last_index).
    """
    met = requests.join(nodes, "node_id")
    fresh = (F.col("last_term") > F.col("log_last_term")) | ((F.col("last_term") == F.col("log_last_term")) & (F.col("last_index") >= F.col("log_last_index")))
    per = W.partitionBy("node_id", "term")
    first = F.min(F.when(fresh, F.struct("arrival", "candidate_id"))).over(per)["candidate_id"]
    return met.withColumn("granted", F.coalesce(fresh & (F.col("candidate_id") == first), F.lit(False))).drop("log_last_term", "log_last_index")


def read_index_quorum(probes: DataFrame, voters: DataFrame) -> DataFrame:
    """(read_context, term, has_quorum): probe answers with the probe's own term and context, one for each peer."""
    good = probes.filter((F.col("resp_term") == F.col("term")) & (F.col("resp_context") == F.col("read_context"))).select("read_context", "term", "node_id").distinct()
    contexts = probes.select("read_context", "term").distinct()
    return quorum(contexts.join(voters, F.lit(True)), good, ("read_context", "term"))


def live_responses(responses: DataFrame, current: DataFrame) -> DataFrame:
    """Responses of the leader's current term and replication generation; others are stale and change nothing."""
    now = current.select(F.col("leader_id").alias("__l"), F.col("term").alias("__t"), F.col("generation").alias("__g"), F.col("role").alias("__r"))
    met = responses.join(now, (F.col("leader_id") == F.col("__l")) & (F.col("term") == F.col("__t")) & (F.col("generation") == F.col("__g")) & (F.col("__r") == "leader"), "left_semi")
    return met


def union_peers(old: DataFrame, new: DataFrame, own_id: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node_id, addr) of both configurations without oneself; the new address wins."""
    own = [*by, "node_id"]
    both = old.select(*own, "addr", F.lit(0).alias("p")).unionByName(new.select(*own, "addr", F.lit(1).alias("p")))
    return both.filter(F.col("node_id") != own_id).groupBy(*own).agg(F.max_by("addr", "p").alias("addr"))


def resolved(members: DataFrame, peers: DataFrame) -> DataFrame:
    """Members with the configured peer address, if there is one, instead of their own."""
    over = peers.select(F.col("node_id").alias("__n"), F.col("addr").alias("__a"))
    return members.join(over, F.col("node_id") == F.col("__n"), "left").withColumn("addr", F.coalesce("__a", "addr")).drop("__n", "__a")


def target_changes(running: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node_id, action): replication to start and to stop."""
    own = [*by, "node_id"]
    start = wanted.select(*own).join(running, own, "left_anti").withColumn("action", F.lit("start"))
    stop = running.select(*own).join(wanted, own, "left_anti").withColumn("action", F.lit("stop"))
    return start.unionByName(stop)


def bootstrap(own_id: int, own_addr: str | None, peers: Column) -> Column:
    """The first configuration: oneself (with a placeholder if the address isn't known) and the configured peers, as a map."""
    own = F.create_map(F.lit(own_id).cast("decimal(20,0)"), F.lit(own_addr or f"unresolved-self-{own_id}"))
    return F.map_concat(own, F.map_filter(peers, lambda k, _: k != own_id))


def add_voter(config: Column, node_id: Column, addr: Column) -> Column:
    """The map with one voter more; a present one fails."""
    return F.when(F.map_contains_key(config, node_id), F.raise_error(F.lit("already a voter")).cast("map<decimal(20,0),string>")).otherwise(F.map_concat(config, F.create_map(node_id, addr)))


def remove_voter(config: Column, node_id: Column) -> Column:
    """The map without a voter; an absent or the last one fails."""
    left = F.map_filter(config, lambda k, _: k != node_id)
    bad = ~F.map_contains_key(config, node_id) | (F.size(left) == 0)
    return F.when(bad, F.raise_error(F.lit("not a voter, or the last one")).cast("map<decimal(20,0),string>")).otherwise(left)


def sorted_voters(config: Column) -> Column:
    """array<struct(node_id, addr)> in numeric order."""
    return F.array_sort(F.transform(F.map_entries(config), lambda e: F.struct(e["key"].alias("node_id"), e["value"].alias("addr"))))


def same_configuration(a: Column, b: Column) -> Column:
    return sorted_voters(a).eqNullSafe(sorted_voters(b))


def valid_configuration(config: Column) -> Column:
    """Not empty, at most 31 voters, no id 0, addresses of 1 to 256 bytes."""
    return (F.size(config) > 0) & (F.size(config) <= MAX_VOTERS) & ~F.exists(F.map_entries(config), lambda e: (e["key"] == 0) | ~F.octet_length(e["value"]).between(1, MAX_ADDRESS))


def recent_contact(role: Column, now_us: Column, last_us: Column, within_us: int = 150_000) -> Column:
    """Whether a node has heard of a leader lately; a leader always has."""
    return F.when(role == "leader", True).otherwise(F.coalesce(now_us - last_us < within_us, F.lit(False)))


def timeout_now_allowed(row_term: Column, current_term: Column, sender: Column, leader: Column, voters: Column, own: Column) -> Column:
    """Whether an order to campaign at once may be followed: of this term, by the known leader, to a voter."""
    return (row_term == current_term) & (sender == leader) & F.array_contains(voters, own)


def transfer_ready(match_index: Column, last_index: Column) -> Column:
    return match_index >= last_index


def leader_hint(status: Column, leader_addr: Column) -> Column:
    """The address sent along with NOT_LEADER; empty if no leader is known."""
    return F.when(status == "NOT_LEADER", F.coalesce(leader_addr, F.lit("")))


def gated(role: Column, status: Column) -> Column:
    """A node that isn't leader answers NOT_LEADER before anything else."""
    return F.when(role != "leader", "NOT_LEADER").otherwise(status)


MODES = {"stable": STABLE, "joint": JOINT}
