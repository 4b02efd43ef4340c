"""Queries of protocol predicates, handlers and labels over facts that are derived from `events`, each with its SQL.

Every event gives a fact, numbers of it being remainders of event numbers, so SQL can state the same facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import evidence, handlers, load, log_ops, quorum, state, status
from . import events as ev
from .oracles import _LOG, _TERMS
from .workloads import _log, _terms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def e_() -> Column:
    return F.col("event_id")


def u_() -> Column:
    return F.col("user_id")



def registering(queries: dict[str, Query], statements: dict[str, str]):
    """A decorator that registers a query under its function's name, with its SQL."""

    def query(sql: str | None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return put

    return query


query = registering(QUERIES, SQL)


def _events(s: SparkSession, d: str) -> DataFrame:
    return ev.events(s, d)


def _pick(by: Column, names: tuple[str | None, ...]) -> Column:
    """The name at a remainder."""
    return F.get(F.array(*[F.lit(n) for n in names]), (by % len(names)).cast("int"))


def _sql_pick(by: str, names: tuple[str | None, ...]) -> str:
    return f"(list_value({', '.join('null' if n is None else repr(n) for n in names)}))[{by} % {len(names)} + 1]"


# Logs.


@query(f"with {_LOG}, {_TERMS} select log_index, term from terms where kind = 0")
def pr4_applications(s, d):
    return state.applications(_terms(_log(s, d))).select("log_index", "term")


@query(f"with {_LOG}, {_TERMS} select log_index, term, k from terms where log_index >= 801")
def pr5_suffix(s, d):
    return log_ops.suffix(_terms(_log(s, d)), 700, 800).select("log_index", "term", "k")


@query(f"with {_LOG}, {_TERMS} select log_index, term, kind, k, v from terms where log_index = 777")
def pr7_entry(s, d):
    return log_ops.entry(_terms(_log(s, d)), 777).select("log_index", "term", "kind", "k", "v")


@query(f"with {_LOG}, {_TERMS} select 0 as base_index, min(log_index) as first_index, max(log_index) as last_index, max_by(term, log_index) as last_term, count(*) as entries from terms")
def sc23_bounds(s, d):
    return log_ops.bounds(_terms(_log(s, d)))


@query("select 'there' as pair, true as matches union all select 'other term', false union all select 'boundary', true")
def jn4_prev_matches(s, d):
    log = _terms(_log(s, d))
    named = lambda n, *a: log_ops.prev_matches(log, *a).select(F.lit(n).alias("pair"), "matches")
    return named("there", 700, 2).unionByName(named("other term", 700, 9)).unionByName(named("boundary", 0, 0))


@query("select event_id as start_index, sha256(event_type) as digest from events where event_id % 4 <> 0")
def jn14_reusable_segments(s, d):
    old = _events(s, d).select(e_().alias("start_index"), F.col("event_type").cast("binary").alias("content"))
    new = _events(s, d).select(e_().alias("start_index"), F.when(e_() % 4 == 0, F.lit("other")).otherwise(F.col("event_type")).cast("binary").alias("content"))
    return log_ops.reusable_segments(old, new).select("start_index", "digest")


def _node_logs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every user a node: its events are its log, numbered from 1, in terms of 512 events; and its state."""
    from pyspark.sql import Window as W

    e = _events(s, d)
    log = e.select(u_().alias("node_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("log_index"), (F.floor(e_() / 512) + 1).alias("term"))
    nodes = e.groupBy(u_().alias("node_id")).agg((F.floor(F.max("event_id") / 512) + 1).alias("current_term"), (F.count("*") - u_() % 3).alias("commit_index"), F.count("*").alias("last_index"))
    return log, nodes.select("*", F.lit(0).cast("bigint").alias("base_index"), F.lit(0).cast("bigint").alias("base_term"))


_NODE_LOGS = """nlog as (select user_id as node_id, row_number() over (partition by user_id order by event_id) as log_index, event_id // 512 + 1 as term from events),
nodes as (select user_id as node_id, max(event_id) // 512 + 1 as current_term, count(*) - user_id % 3 as commit_index, count(*) as last_index from events group by user_id)"""


@query(f"with {_NODE_LOGS} select n.node_id, n.commit_index > 0 and coalesce(l.term = n.current_term, false) as ready from nodes n left join nlog l on l.node_id = n.node_id and l.log_index = n.commit_index")
def pr9_current_term_commit(s, d):
    log, nodes = _node_logs(s, d)
    return handlers.current_term_commit(nodes, log).select("node_id", "ready")


_CALLS = f"""{_NODE_LOGS},
c as (select event_id as call, user_id as node_id, event_id // 512 + 1 - event_id % 2 as term, event_id % 40 as prev_log_index, event_id % 90 as leader_commit from events),
k as (select c.*, n.current_term, n.commit_index, n.last_index, case when prev_log_index = 0 then 0 else l.term end as known,
 case when call % 7 = 0 then 999 when prev_log_index = 0 then 0 else coalesce(l.term, 0) end as prev_log_term
 from c join nodes n using (node_id) left join nlog l on l.node_id = c.node_id and l.log_index = c.prev_log_index),
x as (select call, node_id, prev_log_index + i as log_index, case when call % 5 = 0 and i = 2 then 777 else -1 end as wanted from k cross join (values (1), (2), (3)) v(i)),
y as (select x.call, x.log_index, l.term as own, case when wanted = 777 then 777 else coalesce(l.term, 888) end as sent from x left join nlog l on l.node_id = x.node_id and l.log_index = x.log_index),
p as (select call, min(log_index) filter (where own is null or own <> sent) as f from y group by 1)"""


@query(
    f"""with {_CALLS}, g as (select k.*, f, term >= current_term and coalesce(known = prev_log_term, false) as good from k join p using (call))
select call, node_id, greatest(term, current_term) as answer_term, good as success, case when good then prev_log_index + 3 else 0 end as match_index, case when good then f end as truncate_from,
 case when good then greatest(commit_index, least(leader_commit, case when f is not null then prev_log_index + 3 else last_index end)) else commit_index end as commit_index,
 case when term < current_term then 'candidate' else 'follower' end as role from g"""
)
def ct8_append_answers(s, d):
    """Every event an append call of three entries to its user's node: older terms, wrong entries before and conflicts occur."""
    log, nodes = _node_logs(s, d)
    nodes = nodes.withColumn("role", F.lit("candidate"))
    calls = _events(s, d).select(e_().alias("call"), u_().alias("node_id"), (F.floor(e_() / 512) + 1 - e_() % 2).alias("term"), (e_() % 40).alias("prev_log_index"), (e_() % 90).alias("leader_commit"))
    at = log.select("node_id", F.col("log_index").alias("prev_log_index"), F.col("term").alias("__t"))
    prev = F.when(F.col("call") % 7 == 0, 999).when(F.col("prev_log_index") == 0, 0).otherwise(F.coalesce("__t", F.lit(0)))
    calls = calls.join(at, ["node_id", "prev_log_index"], "left").withColumn("prev_log_term", prev).drop("__t")
    sent = calls.select("call", "node_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "prev_log_index").select("call", "node_id", "i", (F.col("prev_log_index") + F.col("i")).alias("log_index"))
    sent = sent.join(log.withColumnRenamed("term", "__t"), ["node_id", "log_index"], "left")
    entries = sent.select("call", "log_index", F.when((F.col("call") % 5 == 0) & (F.col("i") == 2), 777).otherwise(F.coalesce("__t", F.lit(888))).alias("term"))
    return handlers.append_answers(calls, entries, log, nodes)


@query(
    f"""with {_LOG}, peers as (select distinct user_id as node_id, user_id * 37 % 1200 as next_index from events),
l as (select log_index, octet_length(encode(coalesce(k, ''))) as size from log where log_index > 100),
p as (select node_id, greatest(next_index, 1) as next_index, greatest(next_index, 1) < 101 as needs_snapshot from peers),
m as (select node_id, next_index, l.log_index, size, sum(size + 13) over (partition by node_id order by l.log_index) as total from p join l on l.log_index between next_index and next_index + 63 where not needs_snapshot),
a as (select node_id, count(*) as entries, sum(size) as logical_bytes from m where total <= 500 or log_index = next_index group by 1)
select p.node_id, case when not needs_snapshot then next_index - 1 end as prev_log_index, coalesce(entries, 0) as entries, cast(coalesce(logical_bytes, 0) as bigint) as logical_bytes, needs_snapshot from p left join a using (node_id)"""
)
def st7_replication_calls(s, d):
    peers = _events(s, d).select(u_().alias("node_id"), (u_() * 37 % 1200).alias("next_index")).distinct()
    log = _log(s, d).filter("log_index > 100").select("log_index", F.lit(1).alias("term"), F.coalesce("k", F.lit("")).cast("binary").alias("command"))
    return handlers.replication_calls(peers, log, 64, 500)


@query(
    """with r as (select event_id, event_id % 50 as match_index, event_id % 50 + 1 as next_index, event_id % 3 as generation, event_id % 4 % 3 as sent_generation, 5 as term, 5 - (event_id % 11 = 0)::int as sent_term,
 event_id % 13 <> 0 as leads, event_id % 60 as prev, event_id % 7 as n, 5 + (event_id % 17 = 0)::int as resp_term, event_id % 5 <> 0 as success from events),
a as (select *, case when resp_term > term then 'step_down' when not leads or term <> sent_term or generation <> sent_generation then 'stale' when success then 'advance' else 'back_off' end as action from r)
select event_id, action, case when action = 'advance' and prev + n > match_index then prev + n else match_index end as match_index,
 case when action = 'advance' and prev + n > match_index then prev + n + 1 when action = 'back_off' then greatest(next_index - 1, 1) else next_index end as next_index,
 generation + (action = 'back_off')::int as generation from a"""
)
def st7_replication_advance(s, d):
    sent = _events(s, d).select(
        "event_id",
        (e_() % 50).alias("match_index"),
        (e_() % 50 + 1).alias("next_index"),
        (e_() % 3).alias("generation"),
        (e_() % 4 % 3).alias("sent_generation"),
        F.lit(5).alias("term"),
        F.when(e_() % 11 == 0, 4).otherwise(5).alias("sent_term"),
        F.when(e_() % 13 == 0, "follower").otherwise("leader").alias("role"),
        (e_() % 60).alias("prev_log_index"),
        (e_() % 7).alias("entries"),
        F.when(e_() % 17 == 0, 6).otherwise(5).alias("resp_term"),
        (e_() % 5 != 0).alias("success"),
    )
    return handlers.replication_advance(sent).select("event_id", "action", "match_index", "next_index", "generation")


@query("select event_id, 1 + event_id % 5 as leader_id from events where event_id % 5 <> 2 and event_id % 3 = 0 and event_id % 2 = 1")
def st8_live_responses(s, d):
    responses = _events(s, d).select("event_id", (e_() % 5 + 1).alias("leader_id"), (e_() % 3).alias("term"), (e_() % 2).alias("generation"))
    current = s.range(1, 6).select(F.col("id").alias("leader_id"), F.lit(0).alias("term"), F.lit(1).alias("generation"), F.when(F.col("id") == 3, "follower").otherwise("leader").alias("role"))
    return quorum.live_responses(responses, current).select("event_id", "leader_id")


@query(f"with {_NODE_LOGS}, x as (select node_id, greatest(commit_index, node_id % 50) as commit_index, node_id % 50 + 1 as replay_from, greatest(last_index - node_id % 2 * 4, node_id % 50) as l from nodes) select node_id, commit_index, replay_from, commit_index as replay_to, commit_index <= l as valid from x")
def va4_opened(s, d):
    _, nodes = _node_logs(s, d)
    files = nodes.select("node_id", "commit_index", "base_index", (F.col("last_index") - F.col("node_id") % 2 * 4).alias("last_index"), (F.col("node_id") % 50).alias("snapshot_index"))
    return handlers.opened(files)


@query(f"with {_NODE_LOGS} select event_id, case when event_id // 512 + 1 < current_term then 'stale' when event_id % 60 <= commit_index then 'ignored' else 'installed' end as action from events join nodes on node_id = user_id")
def st11_install_decisions(s, d):
    _, nodes = _node_logs(s, d)
    installs = _events(s, d).select("event_id", u_().alias("node_id"), (F.floor(e_() / 512) + 1).alias("term"), (e_() % 60).alias("index"))
    return handlers.install_decisions(installs, nodes.select("node_id", "current_term", F.col("commit_index").alias("last_applied"))).select("event_id", "action")


@query(
    """with p as (select event_id // 8 as transfer, event_id % 8 as i from events where not (event_id // 8 % 3 = 1 and event_id % 8 = 4)),
a as (select transfer, count(*) as n, max(i) as last, min(i) filter (where i > 4) as late from p group by 1)
select transfer, case when transfer % 3 = 1 and late is not null then 400 else (last + 1) * 100 end as next_offset, last = 7 and transfer % 3 <> 1 as complete from a"""
)
def st11_reassembled(s, d):
    """Eight pieces of 100 bytes a transfer, some without the fifth, some pieces twice."""
    e = _events(s, d).select(F.floor(e_() / 8).alias("transfer"), (e_() % 8).alias("i")).filter(~((F.col("transfer") % 3 == 1) & (F.col("i") == 4)))
    twice = F.explode(F.when(F.col("i") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    pieces = e.select("transfer", "i", twice).select("transfer", (F.col("i") * 100).alias("offset"), F.lit(100).alias("length"), (F.col("i") == 7).alias("done"))
    return handlers.reassembled(pieces).select("transfer", "next_offset", "complete")


@query(f"with {_LOG}, bad as (select min(log_index) as stop from log where client_id % 100 = 99) select log_index, k from log, bad where stop is null or log_index < stop")
def va7_halted(s, d):
    log = _log(s, d)
    return state.halted(log, log.filter("client_id % 100 = 99")).select("log_index", "k")


@query(f"with {_LOG}, more as (select log_index, k, op, v from log union all select log_index + 1000000000, k, 'DELETE', null from log where log_index % 9 = 0), r as (select *, row_number() over (partition by k order by log_index desc) as rn from more) select k, v, log_index from r where rn = 1 and op = 'PUT'")
def st22_unidentified(s, d):
    """Deletes without an identity behind the log, of keys that are there or not."""
    log = _log(s, d).select("log_index", "k", "op", "v")
    more = log.filter("log_index % 9 = 0").select((F.col("log_index") + 1_000_000_000).alias("log_index"), "k", F.lit("DELETE").alias("op"), F.lit(None).cast("bigint").alias("v"))
    return state.live(log.unionByName(more)).select("k", "v", "log_index")


@query("select user_id, min(event_id) filter (where event_type = 'signup' and value > 50) as first_ts from events group by 1")
def st23_first_time(s, d):
    return handlers.first_time(_events(s, d), (F.col("event_type") == "signup") & (F.col("value") > 50), ("user_id",), "event_id").select("user_id", "first_ts")


# Nodes, memberships, votes.


@query("with m as (select distinct user_id from events where event_type = 'signup' and value > 100) select distinct e.user_id as node_id, m.user_id is not null as voter from events e left join m using (user_id)")
def pr11_is_voter(s, d):
    e = _events(s, d)
    members = e.filter("event_type = 'signup' and value > 100").select(_pick(e_(), ("old", "new")).alias("config"), u_().alias("node_id")).distinct()
    return handlers.is_voter(e.select(u_().alias("node_id")).distinct(), members).select("node_id", "voter")


@query("select distinct user_id as node_id, case when user_id % 3 = 0 then 'peer-' else 'member-' end || user_id as addr from events")
def pr12_resolved(s, d):
    members = _events(s, d).select(u_().alias("node_id"), F.concat(F.lit("member-"), u_().cast("string")).alias("addr")).distinct()
    peers = members.filter("node_id % 3 = 0").select("node_id", F.concat(F.lit("peer-"), F.col("node_id").cast("string")).alias("addr"))
    return quorum.resolved(members, peers).select("node_id", "addr")


@query("with n as (select user_id, count(*) as c from events group by 1) select cast(user_id as varchar) as node_key, c as term from n where c % 5 = 0 order by user_id limit 1")
def pr14_leader_of(s, d):
    nodes = _events(s, d).groupBy("user_id").agg(F.count("*").alias("term"))
    statuses = nodes.select(u_().cast("string").alias("node_key"), "term", F.when(F.col("term") % 5 == 0, "leader").otherwise("follower").alias("role"))
    return evidence.leader_of(statuses)


@query("select event_id, user_id % 4 = 0 or event_id * 1000 % 400000 < 150000 as recent from events")
def pr22_recent_contact(s, d):
    role = F.when(u_() % 4 == 0, "leader").otherwise("follower")
    return _events(s, d).select("event_id", quorum.recent_contact(role, F.lit(10**9) + e_() * 1000 % 400000, F.lit(10**9)).alias("recent"))


@query("select event_id, case when event_id % 3 <> 0 then 'NOT_LEADER' else 'OK' end as status, case when event_id % 3 <> 0 then case when event_id % 2 = 0 then 'host-' || user_id else '' end end as hint from events")
def pr28_gate_and_hint(s, d):
    gated = quorum.gated(F.when(e_() % 3 == 0, "leader").otherwise("follower"), F.lit("OK"))
    addr = F.when(e_() % 2 == 0, F.concat(F.lit("host-"), u_().cast("string")))
    return _events(s, d).select("event_id", gated.alias("status"), quorum.leader_hint(gated, addr).alias("hint"))


@query("select event_id, greatest(event_id % 50, least(event_id % 90, event_id % 70)) as commit_index from events")
def ag7_follower_commit(s, d):
    return _events(s, d).select("event_id", quorum.follower_commit(e_() % 50, e_() % 90, e_() % 70).alias("commit_index"))


def _map(*pairs: tuple[Column, Column]) -> Column:
    return F.map_from_arrays(F.array(*[k.cast("decimal(20,0)") for k, _ in pairs]), F.array(*[v for _, v in pairs]))


def _shown(config: Column) -> Column:
    """A configuration as text, voters by number."""
    return F.array_join(F.transform(quorum.sorted_voters(config), lambda v: F.concat_ws("=", v["node_id"].cast("string"), v["addr"])), ",")


@query("select event_id, event_id % 3 <> 0 as same from events")
def jn16_same_configuration(s, d):
    a = _map((u_() + 1, F.lit("x")), (u_() + 20, F.lit("y")))
    b = _map((u_() + 20, F.lit("y")), (u_() + 1, F.when(e_() % 3 == 0, "z").otherwise("x")))
    return _events(s, d).select("event_id", quorum.same_configuration(a, b).alias("same"))


@query("select event_id, (user_id + 1) || '=a,' || (user_id + 2) || '=b,' || (user_id + 3) || '=c' as added, (user_id + 2) || '=b' as removed, '7=own' || ',' || (user_id + 100) || '=p' as first from events")
def se2_voter_changes(s, d):
    two = _map((u_() + 2, F.lit("b")), (u_() + 1, F.lit("a")))
    dec = lambda c: c.cast("decimal(20,0)")
    added = quorum.add_voter(two, dec(u_() + 3), F.lit("c"))
    removed = quorum.remove_voter(two, dec(u_() + 1))
    first = quorum.bootstrap(7, "own", _map((u_() + 100, F.lit("p")), (F.lit(7), F.lit("else"))))
    return _events(s, d).select("event_id", _shown(added).alias("added"), _shown(removed).alias("removed"), _shown(first).alias("first"))


@query("select event_id, event_id % 7 <> 0 and event_id % 5 <> 0 and event_id % 3 <> 0 as valid from events")
def va3_valid_configuration(s, d):
    """Empty configurations, an id of 0 and an address that is too long or empty occur."""
    addr = F.when(e_() % 5 == 0, F.when(e_() % 2 == 0, F.repeat(F.lit("x"), 257)).otherwise("")).otherwise("host:1")
    config = F.when(e_() % 7 == 0, F.map_from_arrays(F.array().cast("array<decimal(20,0)>"), F.array().cast("array<string>"))).otherwise(_map((F.when(e_() % 3 == 0, 0).otherwise(u_() + 9), addr), (F.lit(5), F.lit("host:2"))))
    return _events(s, d).select("event_id", quorum.valid_configuration(config).alias("valid"))


@query("select event_id, event_id % 7 > 2 and (user_id % 4 <> 0) and event_id % 200 >= 150 and event_id % 6 in (1, 2, 3, 4) and (event_id % 5 > 2 or (event_id % 5 = 2 and event_id % 9 >= 4)) as granted from events")
def ct6_pre_vote(s, d):
    rows = _events(s, d).select(
        "event_id",
        (e_() % 7).alias("prospective_term"),
        F.lit(2).alias("current_term"),
        F.when(u_() % 4 == 0, "leader").otherwise("follower").alias("role"),
        (e_() % 200 * 1000).alias("now_us"),
        F.lit(0).alias("contact_us"),
        F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3, 4)]).alias("voters"),
        (e_() % 6).alias("candidate_id"),
        F.lit(1).cast("bigint").alias("node_id"),
        (e_() % 5).alias("last_term"),
        (e_() % 9).alias("last_index"),
        F.lit(2).alias("log_last_term"),
        F.lit(4).alias("log_last_index"),
    )
    return handlers.pre_vote(rows).select("event_id", "granted")


@query("select event_id, event_id % 3 = 1 and event_id % 4 = 2 and user_id % 3 <> 0 as allowed from events")
def ct14_timeout_now(s, d):
    voters = F.when(u_() % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(9)))
    return _events(s, d).select("event_id", quorum.timeout_now_allowed(e_() % 3, F.lit(1), e_() % 4, F.lit(2), voters, F.lit(9)).alias("allowed"))


@query(
    """select event_id, case when event_id % 11 = 0 then 'NOT_LEADER' when event_id % 6 = 1 then 'CANNOT_TRANSFER_TO_SELF' when event_id % 13 = 0 then 'MEMBERSHIP_CHANGE_IN_PROGRESS'
 when event_id % 17 = 0 then 'LEADERSHIP_TRANSFER_IN_PROGRESS' when event_id % 6 not in (1, 2, 3) then 'NOT_A_VOTER' when event_id % 20 < 5 then 'TIMEOUT' when event_id % 7 = 0 then 'TRANSFER_REJECTED' else 'OK' end as status from events"""
)
def ct5_transfer_status(s, d):
    rows = _events(s, d).select(
        "event_id",
        F.when(e_() % 11 == 0, "follower").otherwise("leader").alias("role"),
        F.when(e_() % 13 == 0, 2).otherwise(1).alias("mode"),
        (e_() % 17 == 0).alias("transfer"),
        F.lit(1).cast("bigint").alias("own_id"),
        (e_() % 6).alias("target"),
        F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)]).alias("voters"),
        (e_() % 20).alias("match_index"),
        F.lit(5).alias("last_index"),
        (e_() % 7 != 0).alias("accepted"),
    )
    return handlers.transfer_status(rows).select("event_id", "status")


@query(
    """with j as (select event_id, user_id, case when event_id % 5 = 0 then 'NOT_LEADER' when event_id % 7 = 0 then 'MEMBERSHIP_CHANGE_IN_PROGRESS' when event_id % 11 = 0 then 'LEADERSHIP_TRANSFER_IN_PROGRESS' when event_id % 13 = 0 then 'INVALID_CONFIGURATION' else 'OK' end as status from events),
n as (select event_id, user_id, row_number() over (order by event_id) as n from j where status = 'OK')
select event_id as arrival, 'OK' as status, 100 + 2 * n - 1 + late as log_index, 2 - late as mode, '5=a,' || (user_id + 10) || '=b' as voters, case when late = 0 then '5=a' end as old_voters from n cross join (values (0), (1)) l(late)
union all select event_id, status, null, null, null, null from j where status <> 'OK'"""
)
def ct4_membership_changes(s, d):
    new = F.when(e_() % 13 == 0, _map((F.lit(0), F.lit("a")), (u_() + 10, F.lit("b")))).otherwise(_map((F.lit(5), F.lit("a")), (u_() + 10, F.lit("b"))))
    rows = _events(s, d).select(e_().alias("arrival"), F.when(e_() % 5 == 0, "follower").otherwise("leader").alias("role"), F.when(e_() % 7 == 0, 2).otherwise(1).alias("mode"), (e_() % 11 == 0).alias("transfer"), _map((F.lit(5), F.lit("a"))).alias("old"), new.alias("new"))
    put = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws("=", v["node_id"].cast("string"), v["addr"])), ",").alias(c)
    return handlers.membership_changes(rows, 100).select("arrival", "status", "log_index", "mode", put("voters"), put("old_voters"))


@query(
    """with f as (select user_id, event_id, (list_value('follower', 'candidate', 'leader'))[event_id % 3 + 1] as role, event_id // 200 as term from events),
l as (select *, lag(role) over w as was, lag(term) over w as before from f window w as (partition by user_id order by event_id))
select user_id, event_id, case when term > before and role = 'follower' then 'step_down' else role end as change, term > before as vote_reset from l where was is not null and (was <> role or term <> before)"""
)
def ct13_transitions(s, d):
    facts = _events(s, d).select("user_id", "event_id", _pick(e_(), ("follower", "candidate", "leader")).alias("role"), F.floor(e_() / 200).alias("term"))
    return handlers.transitions(facts, "user_id", "event_id").select("user_id", "event_id", "change", "vote_reset")


_KEY_SQL = "'load-client-' || lpad(cast(event_id % 16 as varchar), 2, '0') || '-write-' || lpad(cast({} as varchar), 5, '0')"


@query(
    f"""with o as (select event_id, event_id // 16 as op from events), k as (select *, op % 10 < 7 as puts, case when op % 10 < 7 then op else op - op % 10 + 6 end as last from o)
select event_id % 16 as worker, op as operation, case when puts then 'PUT' else 'GET' end as kind, {_KEY_SQL.format('last')} as key, case when puts then 'value-' || {_KEY_SQL.format('last')} end as value,
 case when puts then '25' || lpad(lower(to_hex(event_id % 16)), 2, '0') || repeat('0', 28) end as client_id, case when puts then op // 10 * 7 + op % 10 + 1 end as seq from k"""
)
def ct10_load_operations(s, d):
    rows = _events(s, d).select((e_() % load.WORKERS).alias("worker"), F.floor(e_() / load.WORKERS).alias("operation"))
    return load.described(rows).withColumn("client_id", F.lower(F.hex("client_id")))


@query(
    """with r as (select event_id % 10 < 7 as put, (list_value(null, null, null, 'timeout', 'busy', 'eof', 'strange'))[event_id % 7 + 1] as error, event_id % 2 as phase from events)
select phase, count(*) filter (where put and error is null) as acknowledged, count(*) filter (where put and error in ('timeout', 'eof')) as ambiguous_write_outcomes,
 count(*) filter (where not put and error in ('timeout', 'busy', 'eof')) as transient_read_failures, count(*) filter (where error = 'strange') as unexpected from r group by 1"""
)
def ag23_load_outcomes(s, d):
    rows = _events(s, d).select(F.when(e_() % 10 < 7, "PUT").otherwise("GET").alias("kind"), _pick(e_(), (None, None, None, "timeout", "busy", "eof", "strange")).alias("error"), (e_() % 2).alias("phase"))
    return load.outcomes(rows)


@query(
    """with recursive p as (select user_id % 8 as node_id, event_id, event_id % 700 + 50 as bytes, event_id + event_id % 97 as done_at, row_number() over (partition by user_id % 8 order by event_id) as r from events),
w as (select node_id, r, event_id, [{'u': done_at, 'b': bytes}] as q, 'ADMITTED' as outcome from p where r = 1
 union all select p.node_id, p.r, p.event_id,
  case when len(list_filter(w.q, lambda x: x.u > p.event_id)) + 1 <= 4 and coalesce(list_sum(list_transform(list_filter(w.q, lambda x: x.u > p.event_id), lambda x: x.b)), 0) + p.bytes <= 2000
   then list_append(list_filter(w.q, lambda x: x.u > p.event_id), {'u': p.done_at, 'b': p.bytes}) else list_filter(w.q, lambda x: x.u > p.event_id) end,
  case when len(list_filter(w.q, lambda x: x.u > p.event_id)) + 1 <= 4 and coalesce(list_sum(list_transform(list_filter(w.q, lambda x: x.u > p.event_id), lambda x: x.b)), 0) + p.bytes <= 2000 then 'ADMITTED' else 'BUSY' end
  from w join p on p.node_id = w.node_id and p.r = w.r + 1)
select event_id, node_id, outcome from w"""
)
def st5_admission(s, d):
    rows = _events(s, d).select("event_id", (u_() % 8).alias("node_id"), e_().alias("at"), (e_() % 700 + 50).alias("bytes"), (e_() + e_() % 97).alias("done_at"))
    return handlers.admitted(rows, 4, 2000).select("event_id", "node_id", "outcome")


# Labels and messages.

_STATUS = ("OK", "NOT_FOUND", "NOT_LEADER", "TIMEOUT", "INTERNAL", "BAD_REQUEST", "STALE", "CONFLICT", "BUSY")


@query(
    """select event_id, case event_id % 5 when 1 then 'put' when 2 then 'get' when 3 then 'delete' end as operation,
 case event_id % 11 when 1 then 'ok' when 2 then 'not_found' when 3 then 'not_leader' when 4 then 'timeout' when 6 then 'bad_request' when 9 then 'busy' else 'internal' end as status from events"""
)
def pr16_metric_labels(s, d):
    return _events(s, d).select("event_id", labels.metric_operation(e_() % 5).alias("operation"), labels.metric_status(e_() % 11).alias("status"))


_ERRORS = (None, "ambiguous", "timeout", "deadline", "not_found", "not_leader", "busy", "no_leader", "connection_refused", "connection_reset", "eof", "strange")


@query(f"with e as (select event_id, {_sql_pick('event_id', _ERRORS)} as error from events) select event_id, case when error is null then 'ok' when error in ('ambiguous', 'timeout', 'deadline') then 'ambiguous' when error in ('not_found', 'not_leader', 'busy', 'no_leader') then 'expected_read' when error = 'strange' then 'unexpected' else 'transport' end as outcome from e")
def pr17_client_outcomes(s, d):
    return _events(s, d).select("event_id", labels.client_outcome(_pick(e_(), _ERRORS)).alias("outcome"))


@query(f"with e as (select event_id, {_sql_pick('event_id', _STATUS)} as status from events) select event_id, case status when 'OK' then null when 'NOT_FOUND' then null when 'NOT_LEADER' then 'internal' when 'INTERNAL' then 'internal' else lower(status) end as error from e")
def pr18_client_errors(s, d):
    return _events(s, d).select("event_id", labels.client_error(_pick(e_(), _STATUS)).alias("error"))


_ADMIN = (None, "membership_change_in_progress", "leadership_transfer_in_progress", "not_a_voter", "invalid_configuration", "cannot_transfer_to_self", "transfer_rejected", "unknown_target_address", "not_leader", "deadline", "canceled", "closed", "strange")


@query(
    f"""with e as (select event_id, {_sql_pick('event_id', _ADMIN)} as error from events)
select event_id, case when error is null then 'OK' when error = 'unknown_target_address' then 'BAD_REQUEST' when error in ('deadline', 'canceled', 'closed') then 'TIMEOUT' when error = 'strange' then 'INTERNAL' else upper(error) end as status from e"""
)
def pr19_admin_status(s, d):
    return _events(s, d).select("event_id", labels.admin_status(_pick(e_(), _ADMIN)).alias("status"))


@query(f"with e as (select event_id, {_sql_pick('event_id', ('not_leader', 'lost_leadership', 'timeout', 'deadline', 'canceled', 'other'))} as error from events) select event_id, case when error in ('not_leader', 'lost_leadership') then 'NOT_LEADER' when error = 'other' then 'INTERNAL' else 'TIMEOUT' end as status from e")
def pr20_read_failures(s, d):
    return _events(s, d).select("event_id", labels.read_failure_status(_pick(e_(), ("not_leader", "lost_leadership", "timeout", "deadline", "canceled", "other"))).alias("status"))


@query(
    f"""with e as (select event_id, user_id, {_sql_pick('event_id', _STATUS)} as status, {_sql_pick('event_id', ('cluster_ready', 'leader_crashed', 'acknowledged_writes_verified', 'other'))} as event from events)
select event_id, case status when 'OK' then 'ok' when 'NOT_FOUND' then 'key ' || user_id || ' not found' when 'NOT_LEADER' then 'this node is not the leader' when 'TIMEOUT' then 'timed out; a write may or may not have happened'
 when 'BUSY' then 'the node is overloaded, try again' when 'STALE' then 'the request is older than one already handled' when 'CONFLICT' then 'the request number was used for another operation' when 'BAD_REQUEST' then 'the request is malformed' else 'internal error' end as said,
 case event when 'cluster_ready' then 'node ' || user_id || ' leads in term ' || event_id when 'leader_crashed' then 'node ' || user_id || ', the leader, is killed' when 'other' then 'a recorded event' else format('{{:,}}', event_id) || ' acknowledged writes are still there' end as event from e"""
)
def pr21_messages(s, d):
    event = _pick(e_(), ("cluster_ready", "leader_crashed", "acknowledged_writes_verified", "other"))
    return _events(s, d).select("event_id", labels.message(_pick(e_(), _STATUS), u_().cast("string")).alias("said"), labels.event_sentence(event, u_(), e_(), e_()).alias("event"))


_SAID = {"BAD_REQUEST": "the request is invalid", "NOT_A_VOTER": "no voter has that id", "TRANSFER_REJECTED": "the target declined", "INTERNAL": "internal error", "OK": "done"}


@query(
    f"""with e as (select event_id, {_sql_pick('event_id', ('NOT_LEADER', *_SAID))} as status from events)
select event_id, case when status = 'NOT_LEADER' and event_id % 2 = 0 then 'this node is not the leader; try host-' || event_id when status = 'NOT_LEADER' then 'this node is not the leader, and knows of none' {' '.join(f"when status = '{k}' then '{v}'" for k, v in _SAID.items())} end as said from e"""
)
def pr21_admin_messages(s, d):
    hint = F.when(e_() % 2 == 0, F.concat(F.lit("host-"), e_().cast("string")))
    return _events(s, d).select("event_id", labels.admin_message(_pick(e_(), ("NOT_LEADER", *_SAID)), hint).alias("said"))


@query("select event_id, case event_id % 4 when 1 then 'candidate' when 2 then 'leader' else 'follower' end as role, case event_id % 3 when 1 then 'stable' when 2 then 'joint' end as mode, (user_id + 1) || '=a,' || (user_id + 9) || '=b' as voters from events")
def pr25_projections(s, d):
    voters = labels.voter_list(_map((u_() + 9, F.lit("b")), (u_() + 1, F.lit("a"))))
    shown = F.array_join(F.transform(voters, lambda v: F.concat_ws("=", v["id"].cast("string"), v["addr"])), ",")
    return _events(s, d).select("event_id", labels.metric_role(e_() % 4).alias("role"), labels.mode_name(e_() % 3).alias("mode"), shown.alias("voters"))


@query(
    """select event_id, case when event_id % 4 < 2 then (list_value('append_entries', 'pre_vote'))[event_id % 4 + 1] end as rpc, case when event_id % 3 > 0 then (list_value('', 'log', 'snapshot'))[event_id % 3 + 1] end as domain,
 case when event_id % 2 = 0 then 'get' end as operation, case when event_id % 2 = 0 then 'busy' else 'internal' end as status from events"""
)
def pr26_vocabularies(s, d):
    return _events(s, d).select(
        "event_id",
        labels.known_rpc(_pick(e_(), ("append_entries", "pre_vote", "gossip", "x"))).alias("rpc"),
        labels.known_domain(_pick(e_(), ("disk", "log", "snapshot"))).alias("domain"),
        labels.known_operation(_pick(e_(), ("get", "scan"))).alias("operation"),
        labels.known_status(_pick(e_(), ("busy", "odd"))).alias("status"),
    )


@query("select event_id, case event_id % 4 when 0 then 'application' when 1 then 'noop' when 2 then 'configuration' end as kind, case event_id % 3 when 1 then 'PUT' when 2 then 'DELETE' end as op, case event_id % 10 " + " ".join(f"when {i + 1} then '{n}'" for i, n in enumerate(("OK", "NOT_FOUND", "NOT_LEADER", "TIMEOUT", "INTERNAL", "BAD_REQUEST", "STALE", "CONFLICT", "BUSY"))) + " end as status, case event_id % 4 when 0 then 1 when 1 then 1 when 2 then 7 else 8 end as code from events")
def fn22_names(s, d):
    outcome = _pick(e_(), ("NEW", "DUPLICATE", "STALE", "CONFLICT"))
    return _events(s, d).select("event_id", labels.kind_name(e_() % 4).alias("kind"), labels.op_name(e_() % 3).alias("op"), labels.status_name(e_() % 10).alias("status"), labels.outcome_status(outcome).alias("code"))


# Text forms.


@query(
    """select event_id, case event_id % 4 when 0 then 'want ID=ADDRESS' when 1 then 'the id must be a positive number' when 2 then 'the address is empty' end as error,
 case when event_id % 4 = 3 then event_id end as node_id, case when event_id % 4 = 3 then 'h=1:' || user_id end as addr from events"""
)
def fn15_peers(s, d):
    n = e_().cast("string")
    typed = F.when(e_() % 4 == 0, n).when(e_() % 4 == 1, F.concat(F.lit("0=h"), n)).when(e_() % 4 == 2, F.concat((e_() + 1).cast("string"), F.lit("="))).otherwise(F.concat(n, F.lit("=h=1:"), u_().cast("string")))
    p = _events(s, d).select("event_id", text.peer(typed).alias("p"))
    return p.select("event_id", "p.error", F.col("p.node_id").cast("bigint").alias("node_id"), "p.addr")


@query(f"select event_id, 'a|' || user_id || '|b' as items, {_KEY_SQL.format('user_id')} as key from events")
def fn15_lists_and_keys(s, d):
    listed = text.items(F.concat(F.lit(" a ,, "), u_().cast("string"), F.lit(" ,b,  ")))
    return _events(s, d).select("event_id", F.array_join(listed, "|").alias("items"), text.load_key(e_() % 16, u_()).alias("key"))


@query("select event_id, case when event_id % 3 <> 0 then event_id end as generation, 'x=\"' || case when event_id % 2 = 0 then 'a\\\"b' else 'c' end || '\"' as label, event_id % 2 = 0 as is_hash from events")
def fn16_names_and_quotes(s, d):
    name = F.concat(F.when(e_() % 3 == 0, "h").otherwise("g"), F.lpad(e_().cast("string"), 20, "0"))
    sha = F.when(e_() % 2 == 0, F.sha1(F.col("event_type"))).otherwise(F.concat(F.sha1(F.col("event_type")), F.lit("0")))
    return _events(s, d).select("event_id", text.generation_number(name).cast("bigint").alias("generation"), text.labelled("x", F.when(e_() % 2 == 0, 'a"b').otherwise("c")).alias("label"), text.is_commit_hash(sha).alias("is_hash"))


@query("select event_id, '25' || lpad(lower(to_hex(user_id % 256)), 2, '0') || lpad(lower(to_hex(event_id % 256)), 2, '0') || lpad(lower(to_hex(event_id // 256 % 256)), 2, '0') || repeat('0', 24) as client_id from events")
def fn20_session_ids(s, d):
    return _events(s, d).select("event_id", F.lower(F.hex(text.session_client_id(u_(), e_()))).alias("client_id"))


@query("select event_id, format('{:,}', event_id * 1000) as grouped, case when length(printf('%.3f', event_id / 8)) < 6 then lpad(printf('%.3f', event_id / 8), 6, '0') else printf('%.3f', event_id / 8) end as clock from events")
def fn21_formats(s, d):
    return _events(s, d).select("event_id", text.grouped(e_() * 1000).alias("grouped"), text.clock(e_() / 8).alias("clock"))


# Status.


def _nodes(s: SparkSession, d: str) -> DataFrame:
    """Every user a recorded node."""
    n = _events(s, d).groupBy("user_id").agg(F.count("*").alias("c"), F.max("event_id").alias("m"))
    voters = lambda *ids: F.array(*[F.struct((u_() + i).alias("id"), F.concat(F.lit("h:"), F.lit(str(i))).alias("addr")) for i in ids])
    return n.select(
        u_().alias("node_id"),
        (u_() % 3).cast("int").alias("role"),
        (F.col("c") + 1).alias("current_term"),
        F.when(u_() % 2 == 0, u_()).alias("voted_for"),
        F.when(u_() % 5 != 0, u_() % 3 + 1).alias("leader_id"),
        F.col("m").alias("last_log_index"),
        (F.col("m") - 3).alias("commit_index"),
        (F.col("m") - 3 - u_() % 4 + u_() % 7).alias("last_applied"),
        (F.col("c") * 2).alias("snapshot_index"),
        F.col("c").alias("snapshot_term"),
        F.when(u_() % 4 == 0, 2).otherwise(1).alias("mode"),
        voters(3, 1).alias("voters"),
        voters(2, 1).alias("old_voters"),
        voters(4, 2).alias("new_voters"),
        F.when(u_() % 9 == 0, "broken").alias("apply_error"),
    )


_NODES = """n as (select user_id as u, count(*) as c, max(event_id) as m from events group by 1),
f as (select u as node_id, case u % 3 when 1 then 'candidate' when 2 then 'leader' else 'follower' end as role, c + 1 as term, case when u % 5 <> 0 then u % 3 + 1 else 0 end as leader_id, m as last_log_index, m - 3 as commit_index,
 m - 3 - u % 4 + u % 7 as last_applied, greatest(u % 4 - u % 7, 0) as apply_lag, c * 2 as snapshot_index, c as snapshot_term, case when u % 4 = 0 then 'joint' else 'stable' end as membership, u from n)"""


@query(
    f"""with {_NODES} select node_id, role, term, leader_id, last_log_index, commit_index, last_applied, apply_lag, snapshot_index, snapshot_term, membership,
 case when u % 4 <> 0 then (u + 1) || ',' || (u + 3) else '' end as voters, case when u % 4 = 0 then (u + 1) || ',' || (u + 2) else '' end as old_voters, case when u % 4 = 0 then (u + 2) || ',' || (u + 4) else '' end as new_voters from f"""
)
def pr23_full_status(s, d):
    out = status.full_status(_nodes(s, d))
    ids = lambda c: F.array_join(F.transform(c, lambda v: v["id"].cast("string")), ",").alias(c)
    return out.select(*[c for c in out.columns if not c.endswith("voters")], ids("voters"), ids("old_voters"), ids("new_voters"))


@query(f"with {_NODES} select node_id, term, commit_index, last_applied, last_log_index, role, role = 'leader' as leader, term - 1 as proposals_admitted, 0 as proposals_busy, case when u % 2 = 0 then u else 0 end as connections_dialed from f")
def pr24_metrics_snapshot(s, d):
    nodes = _nodes(s, d)
    proposals = nodes.select("node_id", (F.col("current_term") - 1).alias("proposals_admitted"), (-F.col("node_id") - 1).alias("proposals_busy"))
    transport = nodes.filter("node_id % 2 = 0").select("node_id", F.col("node_id").alias("connections_dialed"))
    return status.metrics_snapshot(nodes, proposals, transport)


@query(
    f"""with {_NODES} select node_id, x.name, x.value from (select node_id, unnest([{{'name': 'role', 'value': role}}, {{'name': 'term', 'value': cast(term as varchar)}}, {{'name': 'vote', 'value': case when u % 2 = 0 then cast(u as varchar) end}},
 {{'name': 'leader_hint', 'value': case when u % 5 <> 0 then cast(leader_id as varchar) end}}, {{'name': 'commit_index', 'value': cast(commit_index as varchar)}}, {{'name': 'last_index', 'value': cast(last_log_index as varchar)}},
 {{'name': 'snapshot_index', 'value': cast(snapshot_index as varchar)}}, {{'name': 'snapshot_term', 'value': cast(snapshot_term as varchar)}}, {{'name': 'last_applied', 'value': cast(last_applied as varchar)}}, {{'name': 'apply_error', 'value': case when u % 9 = 0 then 'broken' end}}]) as x from f)"""
)
def pr27_values(s, d):
    return status.values(_nodes(s, d))


@query(
    f"""with {_NODES} select node_id, 'node:           ' || node_id || chr(10) || 'role:           ' || role || chr(10) || 'term:           ' || term || chr(10) || 'leader:         ' || case when leader_id = 0 then 'unknown' else cast(leader_id as varchar) end || chr(10)
 || 'last-log-index: ' || last_log_index || chr(10) || 'commit-index:   ' || commit_index || chr(10) || 'last-applied:   ' || last_applied || chr(10) || 'apply-lag:      ' || apply_lag || chr(10) || 'snapshot-index: ' || snapshot_index || chr(10)
 || 'snapshot-term:  ' || snapshot_term || chr(10) || 'membership:     ' || membership || chr(10)
 || case when u % 4 = 0 then 'old voters:' || chr(10) || '  ' || (u + 1) || ' h:1' || chr(10) || '  ' || (u + 2) || ' h:2' || chr(10) || 'new voters:' || chr(10) || '  ' || (u + 2) || ' h:2' || chr(10) || '  ' || (u + 4) || ' h:4' || chr(10)
  else 'voters:' || chr(10) || '  ' || (u + 1) || ' h:1' || chr(10) || '  ' || (u + 3) || ' h:3' || chr(10) end as text from f"""
)
def sk15_status_print(s, d):
    return status.printed(status.full_status(_nodes(s, d))).select("node_id", "text")


@query(f"with {_NODES} select node_id, role, term, case when leader_id <> 0 then leader_id end as leader, last_log_index, commit_index, last_applied, apply_lag, snapshot_index, snapshot_term, membership, case when u % 4 <> 0 then (u + 1) || ',' || (u + 3) end as voters from f")
def sc16_parsed_status(s, d):
    """The printed status of every node, read back; voters are read where the addresses are local ones."""
    shown = status.printed(status.full_status(_nodes(s, d)))
    local = shown.select("node_id", F.regexp_replace("text", r"h:([0-9])", "127.0.0.1:$1").alias("value"))
    out = evidence.parse_status(local)
    return out.select("node_id", "role", "term", "leader", "last_log_index", "commit_index", "last_applied", "apply_lag", "snapshot_index", "snapshot_term", "membership", F.array_join("voters", ",").alias("voters"))


@query(f"with {_NODES}, x as (select u as node_id from n union all select u + 100000 from n where u % 2 = 0) select x.node_id, f.term, f.node_id is not null as reachable from x left join f using (node_id)")
def sc17_probed(s, d):
    nodes = _nodes(s, d)
    expected = nodes.select("node_id").unionByName(nodes.filter("node_id % 2 = 0").select((F.col("node_id") + 100_000).alias("node_id")))
    return status.probed(expected, nodes.select("node_id", F.col("current_term").alias("term"))).select("node_id", "term", "reachable")


@query(f"with {_NODES} select node_id, u % 9 <> 0 as healthy, u % 9 <> 0 and u % 5 <> 0 as ready from f")
def sc22_health(s, d):
    return status.health(_nodes(s, d))


@query(f"with {_NODES} select (max(last_applied) filter (where node_id = 3)) >= (max(commit_index) filter (where node_id <> 3)) as caught_up from f")
def ag21_caught_up(s, d):
    nodes = _nodes(s, d).select(F.col("node_id").cast("string").alias("node_key"), "last_applied", "commit_index")
    return evidence.caught_up(nodes, "3")


@query(f"with {_NODES} select (count(*) filter (where u % 6 <> 5 and role = 'leader')) = 1 as one_leader, coalesce(bool_and(u % 6 <> 5 and membership = 'stable' and apply_lag = 0), false) as all_converged from f")
def ag22_converged(s, d):
    full = status.full_status(_nodes(s, d))
    rows = full.select("role", "membership", "apply_lag", (F.col("node_id") % 6 != 5).alias("reachable"), F.col("voters.id").alias("voters"))
    return evidence.converged(rows, 2)
