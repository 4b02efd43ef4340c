"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_LOG = """log as (select event_id + 1 as log_index, user_id as client_id, json_extract_string(props, '$.k') as k,
 case when event_type = 'error' then 'DELETE' else 'PUT' end as op,
 case when event_type <> 'error' then cast(round(value * 100) as bigint) end as v from events)"""

_ANOMALY = """base as (select event_id, user_id as client_id, json_extract_string(props, '$.k') as k,
 case when event_type = 'error' then 'DELETE' else 'PUT' end as op,
 case when event_type <> 'error' then cast(round(value * 100) as bigint) end as v,
 row_number() over (partition by user_id order by event_id) as seq from events),
kept as (select * from base where not (client_id % 50 = 7 and seq = 20)),
every as (select event_id * 3 as pos, client_id, k, op, v, seq from kept
 union all select event_id * 3 + 1, client_id, k, op, v, seq from kept where event_id % 10 = 0
 union all select event_id * 3 + 1, client_id, k, op, v + 1, seq from kept where event_id % 10 = 5 and op = 'PUT'
 union all select event_id * 3 + 2, client_id, k, op, v, seq + 5 from kept where event_id % 10 = 7),
alog as (select row_number() over (order by pos) as log_index, client_id, seq, k, op, v,
 sha256(op || '|' || coalesce(k, '') || '|' || coalesce(cast(v as varchar), '')) as fp from every)"""

_CLASSIFIED = (
    _ANOMALY
    + """,
ranked as (select *, row_number() over (partition by client_id order by log_index) as r from alog),
walk as (select client_id, cast(0 as bigint) as r, cast(0 as bigint) as last_seq, cast(null as varchar) as last_fp, cast(null as varchar) as outcome, cast(null as bigint) as log_index
 from (select distinct client_id from ranked)
 union all
 select w.client_id, cast(x.r as bigint),
  case when x.seq = w.last_seq + 1 then cast(x.seq as bigint) else w.last_seq end,
  case when x.seq = w.last_seq + 1 then x.fp else w.last_fp end,
  case when x.seq = w.last_seq then (case when x.fp = w.last_fp then 'DUPLICATE' else 'CONFLICT' end) when x.seq = w.last_seq + 1 then 'NEW' else 'STALE' end,
  cast(x.log_index as bigint)
 from walk w join ranked x on x.client_id = w.client_id and x.r = w.r + 1),
classified as (select a.*, w.outcome from alog a join walk w on a.log_index = w.log_index)"""
)

_LIVE = "select k, v, log_index from (select *, row_number() over (partition by k order by log_index desc) as rn from {0}) where rn = 1 and op = 'PUT'"
_TERMS = "terms as (select log_index, log_index // 512 + 1 as term, case when log_index % 97 = 0 then 1 else 0 end as kind, k, v from log)"
_OBS = """obs as (select event_id, event_type, user_id,
 case when event_type = 'view' then 'get' when event_type = 'error' then 'delete' when event_type = 'signup' then 'scan' else 'put' end as operation,
 case when event_id % 11 = 0 then 'busy' when event_id % 13 = 0 then 'stale' when event_id % 7 = 0 then 'not_found' else 'ok' end as status,
 cast(round(value * 10000) as bigint) as duration_ns from events)"""
_BOUNDS = "bounds as (select * from (values ('0.0001', 0.0001), ('0.0005', 0.0005), ('0.001', 0.001), ('0.005', 0.005), ('0.01', 0.01), ('0.05', 0.05), ('0.1', 0.1), ('0.5', 0.5), ('1', 1.0), ('5', 5.0), ('+Inf', 1e300)) t(le, bound))"
_HIST = f"{_OBS}, {_BOUNDS}, hist as (select event_type, le, bound, count(*) filter (where duration_ns / 1e9 <= cast(bound as double)) as cumulative_count from obs cross join bounds group by all)"
_FINGER = "sha256({})"
_EPOCH = "cast(floor(epoch(ts)) as bigint)"
_RECORDS = "records as (select client_id, max(seq) as last_seq, max_by(fp, seq) as last_fingerprint from classified where outcome = 'NEW' group by 1)"
_CONFIG = "config as (select * from (values ('old', 1), ('old', 2), ('old', 3), ('new', 2), ('new', 3), ('new', 4), ('new', 5)) t(config, node_id))"
_STABLE = "stable as (select * from (values (1), (2), (3), (4), (5)) t(node_id))"


def _be(number: str, width: int) -> str:
    return f"lpad(lower(to_hex({number})), {2 * width}, '0')"


def _text_hex(column: str) -> str:
    return f"lower(hex(cast({column} as varchar)))"


_KEY, _VALUE = "coalesce(k, '')", "coalesce(cast(v as varchar), '')"
_TAIL = f"{_be(f'cast(octet_length(encode({_KEY})) as bigint)', 4)} || {_be(f'cast(octet_length(encode({_VALUE})) as bigint)', 4)} || {_text_hex(_KEY)} || {_text_hex(_VALUE)}"

SQL = {
    "ag1_lww_state": f"with {_LOG} {_LIVE.format('log')}",
    "ag1_lww_anomaly_state": f"with {_ANOMALY} {_LIVE.format('alog')}",
    "ag2_dedup_outcomes": f"with recursive {_CLASSIFIED} select outcome, count(*) as commands from classified group by 1",
    "ag2_classified_log": f"with recursive {_CLASSIFIED} select log_index, client_id, seq, outcome from classified",
    "ag2_identified_state": f"with recursive {_CLASSIFIED}, fresh as (select * from classified where outcome = 'NEW') {_LIVE.format('fresh')}",
    "d5_client_records": f"with recursive {_CLASSIFIED}, {_RECORDS} select client_id, last_seq, last_fingerprint, cast(1 as tinyint) as last_result from records",
    "pr13_lookup": f"with recursive {_CLASSIFIED}, {_RECORDS} select client_id, last_seq + o as seq, case when o = 0 then 'DUPLICATE' when o = 1 then 'NEW' else 'STALE' end as outcome from records cross join (values (-1), (0), (1), (2)) t(o)",
    "jn17_single_flight": f"with {_ANOMALY} select client_id, seq, count(*) as waiters, case when min(fp) = max(fp) then 'SHARED' else 'CONFLICT' end as outcome from alog group by 1, 2",
    "pr1_point_reads": f"with {_LOG}, st as ({_LIVE.format('log')}), q as (select cast(range as varchar) as k from range(120)) select q.k, st.v, case when st.k is null then 'NOT_FOUND' else 'OK' end as status from q left join st on q.k = st.k",
    "pr2_get_at_index": f"with {_LOG}, pre as (select * from log where log_index <= 5000), st as ({_LIVE.format('pre')}), q as (select cast(range as varchar) as k from range(120)) select q.k, st.v, case when st.k is null then 'NOT_FOUND' else 'OK' end as status from q left join st on q.k = st.k",
    "pr3_committed_prefix": f"with {_LOG} select log_index, k, op, v from log where log_index > 100 and log_index <= 900",
    "pr6_entries_range": f"with {_LOG}, r as (select *, row_number() over (order by log_index) as rn, sum(length(k) + coalesce(length(cast(v as varchar)), 0) + 13) over (order by log_index rows unbounded preceding) as total from log where log_index >= 100) select log_index, k, v from r where rn = 1 or (rn <= 64 and total <= 500)",
    "se6_compaction": f"with {_LOG}, {_TERMS} select log_index, term, kind from terms where log_index > 600",
    "se7_install_boundary": f"with {_LOG}, {_TERMS} select 'matching' as boundary, count(*) as entries from terms where log_index > 600 union all select 'other term', 0",
    "se6_snapshot_suffix": f"with {_LOG} {_LIVE.format('log')}",
    "pr8_term_at": f"with {_LOG}, {_TERMS}, q as (select range as log_index from range(590, 1200, 30)) select q.log_index, case when q.log_index = 650 then 2 when q.log_index > 650 then t.term end as term from q left join terms t using (log_index)",
    "wn2_gap_detection": f"with {_LOG}, b as (select (log_index - 1) // 64 as n, min(log_index) as m, count(*) as entries from log group by 1), g as (select m + case when n % 11 = 10 then 3 when n % 13 = 12 then -2 else 0 end as start_index, entries from b) select start_index, entries from (select *, lag(start_index + entries, 1, 1) over (order by start_index) as expected from g) where start_index <> expected",
    "ag24_batches": """with recursive p as (select user_id % 8 as node_id, event_id % 700 + 50 as bytes, row_number() over (partition by user_id % 8 order by event_id) as r from events),
w as (select node_id, r, cast(0 as bigint) as batch, cast(1 as bigint) as n, cast(bytes as bigint) as total, cast(bytes as bigint) as bytes from p where r = 1
 union all select p.node_id, p.r, case when w.n >= 16 or w.total + p.bytes > 4096 then w.batch + 1 else w.batch end, case when w.n >= 16 or w.total + p.bytes > 4096 then 1 else w.n + 1 end, case when w.n >= 16 or w.total + p.bytes > 4096 then p.bytes else w.total + p.bytes end, p.bytes from w join p on p.node_id = w.node_id and p.r = w.r + 1)
select node_id, batch, count(*) as entries, cast(sum(bytes) as bigint) as bytes from w group by 1, 2""",
    "ag25_encoded_sizes": f"with {_LOG} select op, count(*) as entries, cast(sum(octet_length(encode(coalesce(cast(v as varchar), ''))) + 13) as bigint) as bytes, cast(sum(octet_length(encode(coalesce(cast(v as varchar), '')))) as bigint) as logical_bytes from log group by 1",
    "ag6_commit_index": f"""with {_CONFIG}, {_STABLE}, e as (select event_id as view, event_id % 5 + 1 as leader, event_id % 800 + 200 as last_index from events),
v as (select view, leader, last_index, 'old' as config, node_id from e cross join stable where view % 2 = 0 union all select view, leader, last_index, config, node_id from e cross join config where view % 2 = 1),
m as (select view, config, last_index, case when node_id = leader then last_index when (view + node_id) % 7 = 0 then 0 else greatest(0, last_index - (view * node_id) % 211) end as match from v),
r as (select *, row_number() over (partition by view, config order by match desc) as rn, count(*) over (partition by view, config) as n from m),
k as (select view, min(match) as best from r where rn = n // 2 + 1 group by 1)
select view, case when best > 300 and best >= 500 then best else 300 end as commit_index from k""",
    "ag4_quorum": f"with {_STABLE}, a as (select distinct event_id // 4 as round, event_id * 7 % 6 + 1 as node_id from events) select round, count(*) filter (where node_id in (select node_id from stable)) >= 3 as has_quorum from a group by 1",
    "ag5_joint_quorum": "with a as (select distinct event_id // 5 as round, event_id * 11 % 7 + 1 as node_id from events) select round, count(*) filter (where node_id in (1, 2, 3)) >= 2 and count(*) filter (where node_id in (2, 3, 4, 5)) >= 3 as has_quorum from a group by 1",
    "ag8_membership": """with c as (select user_id as node_id, max(event_id) - user_id % 40 * 20 as commit_index from events group by user_id),
e as (select user_id as node_id, event_id + 1 as log_index, case when event_type = 'signup' then 2 else 1 end as mode from events where event_type in ('signup', 'purchase')),
m as (select e.*, mode = 2 or log_index <= commit_index as active from e join c using (node_id)),
a as (select node_id, log_index, mode from (select *, row_number() over (partition by node_id order by log_index desc) as rn from m where active) where rn = 1)
select a.node_id, a.log_index, a.mode, (select max(m.log_index) from m where m.node_id = a.node_id and not m.active and m.log_index > a.log_index) as pending_stable from a""",
    "ag9_vote_tally": "with v as (select distinct event_id // 6 as term, event_id % 2 as candidate_id, event_id * 13 % 7 + 1 as voter_id from events where event_type <> 'error') select term, candidate_id, count(*) as granted, count(*) >= 3 as has_quorum from v where voter_id <= 5 group by 1, 2",
    "ct7_vote_decisions": """with r as (select event_id as arrival, user_id % 5 as node_id, event_id // 20 as term, event_id % 3 as candidate_id, event_id % 4 as last_term, event_id % 50 as last_index from events),
f as (select *, last_term > 2 or (last_term = 2 and last_index >= node_id * 10) as fresh from r),
g as (select node_id, term, min_by(candidate_id, arrival) as first from f where fresh group by 1, 2)
select arrival, f.node_id, f.term, candidate_id, coalesce(fresh and candidate_id = first, false) as granted from f left join g on f.node_id = g.node_id and f.term = g.term""",
    "pr10_log_up_to_date": "select event_id, event_id % 5 > event_id % 4 or (event_id % 5 = event_id % 4 and event_id % 17 >= event_id % 13) as up_to_date from events",
    "st20_read_index": "with p as (select event_id // 8 as read_context, event_id % 6 + 1 as node_id, event_id % 9 <> 0 and event_id % 5 <> 0 as good from events) select read_context, count(distinct node_id) filter (where good and node_id <= 5) >= 3 as has_quorum from p group by 1",
    "ag10_requests_total": f"with {_OBS}, grid as (select * from (values ('get'), ('put'), ('delete')) a(operation) cross join (values ('ok'), ('not_found'), ('busy'), ('timeout'), ('not_leader'), ('bad_request'), ('internal')) b(status)), n as (select operation, case when status = 'stale' then 'internal' else status end as status, count(*) as c from obs where operation <> 'scan' group by 1, 2) select g.operation, g.status, coalesce(c, 0) as requests from grid g left join n on g.operation = n.operation and g.status = n.status",
    "ag12_histogram": f"with {_HIST} select event_type, le, cumulative_count from hist",
    "ag12_histogram_totals": f"with {_OBS} select event_type, cast(sum(greatest(duration_ns, 0)) as bigint) as sum_ns, count(*) as count from obs group by 1",
    "ag13_counters": f"with {_OBS} select operation, count(*) filter (where status = 'busy') as busy, count(*) filter (where status not in ('ok', 'not_found')) as failures, count(*) filter (where duration_ns > 3000000) as slow from obs group by 1",
    "ag14_gauges": f"with {_OBS} select user_id, max_by(duration_ns, event_id) as duration_ns from obs group by 1",
    "ag15_percentile_floor": f"with {_OBS}, r as (select event_type, duration_ns, row_number() over (partition by event_type order by duration_ns) - 1 as i, count(*) over (partition by event_type) as n from obs) select event_type, max(n) as n, max(duration_ns) filter (where i = floor(0.5 * (n - 1))) as p50, max(duration_ns) filter (where i = floor(0.95 * (n - 1))) as p95, max(duration_ns) filter (where i = floor(0.99 * (n - 1))) as p99 from r group by 1",
    "ag16_write_amplification": f"with {_OBS} select event_type, cast(sum(length(operation) + event_id % 100 + 25) as bigint) as physical_bytes, cast(sum(length(operation) + event_id % 100) as bigint) as logical_bytes, round(sum(length(operation) + event_id % 100 + 25) / sum(length(operation) + event_id % 100), 6) as amplification from obs group by 1",
    "ag19_high_water": "with m as (select user_id % 10 as node_id, sum(case when event_type in ('view', 'click', 'purchase') then 1 else -1 end) over (partition by user_id % 10 order by event_id rows unbounded preceding) as n from events) select node_id, cast(max(n) as bigint) as high_water from m group by 1",
    "wn4_lags": "select event_id, greatest(event_id % 100 - event_id % 70, 0) as apply_lag, greatest(event_id % 90 - event_id % 110, 0) as peer_lag from events",
    "wn6_role_changes": "select user_id, event_id, previous, role from (select user_id, event_id, event_type as role, lag(event_type) over (partition by user_id order by event_id) as previous from events) where previous <> role",
    "wn9_counter_increases": "with c as (select user_id % 20 as node_id, event_id, event_id % 1000 as value, lag(event_id % 1000) over (partition by user_id % 20 order by event_id) as before from events) select node_id, event_id, case when before is null then null when value < before then value else value - before end as increase from c",
    "wn10_histogram_quantile": f"""with {_HIST}, h as (select *, lag(bound, 1, 0) over (partition by event_type order by bound) as low, lag(cumulative_count, 1, 0) over (partition by event_type order by bound) as below, 0.95 * max(cumulative_count) over (partition by event_type) as rank from hist),
f as (select *, row_number() over (partition by event_type order by bound) as rn from h where cumulative_count >= rank)
select event_type, round(case when le = '+Inf' then 5.0 else low + (bound - low) * (rank - below) / (cumulative_count - below) end, 9) as quantile from f where rn = 1""",
    "wn11_sustained_alert": f"""with e as (select user_id, {_EPOCH} as ts, value > 20 as hot from events), l as (select *, lag(hot, 1, false) over (partition by user_id order by ts) as was from e),
r as (select *, sum(case when hot and not was then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as run from l),
a as (select *, min(ts) over (partition by user_id, run) as since from r where hot)
select user_id, min(ts) as started, max(ts) as ended, min(ts) filter (where ts - since >= 20000) as fires_at from a group by user_id, run having min(ts) filter (where ts - since >= 20000) is not null""",
    "wn12_instant_max": f"select {_EPOCH} // 3600 * 3600 as ts, event_type, max(event_id % 37) as value from events group by 1, 2",
    "jn15_missing_events": "select event_type from (values ('click'), ('view'), ('logout'), ('refund')) t(event_type) where event_type not in (select event_type from events)",
    "fn1_fingerprint": f"with {_LOG} select log_index, sha256(op || '|' || coalesce(k, '') || '|' || coalesce(cast(v as varchar), '')) as fp from log",
    "fn1_binary_fingerprint": f"with {_LOG} select log_index, sha256(from_hex(case when op = 'PUT' then '01' else '02' end || {_be(f'cast(octet_length(encode({_KEY})) as bigint)', 4)} || {_text_hex(_KEY)} || {_be(f'cast(octet_length(encode({_VALUE})) as bigint)', 4)} || {_text_hex(_VALUE)})) as fp from log",
    "fn4_command_codec": f"""with base as (select event_id, user_id as client_id, json_extract_string(props, '$.k') as k, case when event_type = 'error' then 2 else 1 end as o,
 case when event_type <> 'error' then cast(round(value * 100) as bigint) end as v, row_number() over (partition by user_id order by event_id) as s from events)
select event_id, case when client_id % 3 <> 0 then '02' || {_be('o', 1)} || {_be('client_id + 1', 8)} || '0000000000000000' || {_be('s', 8)} else '01' || {_be('o', 1)} end || {_TAIL} as encoded,
 cast(null as varchar) as error, o as op, case when client_id % 3 <> 0 then s end as seq, {_KEY} as key, {_VALUE} as value from base""",
}

_INCOMING = "incoming as (select log_index, case when log_index >= 800 then term + 3 else term end as term, kind, k, coalesce(v, 0) + 7 as v from terms)"
_CONFLICT = f"{_LOG}, {_TERMS}, {_INCOMING}, c as (select min(i.log_index) as first_conflict from incoming i left join terms t using (log_index) where t.term is null or t.term <> i.term)"
_ACKS = """acks as (select client_id || '-' || k as key, cast(v as varchar) as value, log_index, case when log_index <= 6000 then 'before' else 'after' end as phase from log where op = 'PUT'),
kstate as (select key, value from (select client_id || '-' || k as key, op, cast(v as varchar) as value, row_number() over (partition by client_id, k order by log_index desc) as rn from log) where rn = 1 and op = 'PUT'),
checked as (select a.*, s.key is not null and a.value is not distinct from s.value as verified from acks a left join kstate s on a.key = s.key)"""
_CHANGES = """o as (select distinct event_id // 400 as change, user_id as node_id from events where event_id % 400 < 200),
n as (select distinct event_id // 400 as change, user_id as node_id from events where event_id % 400 >= 100)"""

SQL |= {
    "jn3_first_conflict": f"with {_CONFLICT} select first_conflict from c",
    "se5_conflict_repair": f"with {_CONFLICT} select t.* from terms t, c where first_conflict is null or t.log_index < first_conflict union all select i.* from incoming i, c where i.log_index >= first_conflict",
    "jn5_range_equality": f"""with {_LOG}, {_TERMS}, last as (select max(log_index) as last from terms),
others as (select 'equal' as pair, terms.* from terms union all select 'shorter', terms.* from terms, last where log_index < last
 union all select 'changed', log_index, term, kind, k, case when log_index = last then coalesce(v, 0) + 1 else v end from terms, last),
pairs as (select * from (values ('equal'), ('shorter'), ('changed')) p(pair))
select pair, not exists (select log_index, term, kind, k, v from terms except select log_index, term, kind, k, v from others o where o.pair = p.pair)
 and not exists (select log_index, term, kind, k, v from others o where o.pair = p.pair except select log_index, term, kind, k, v from terms) as same from pairs p""",
    "jn9_waiters": f"with {_LOG}, {_TERMS} select log_index, term + log_index % 2 as term, case when log_index % 2 = 0 then 'APPLIED' else 'ENTRY_LOST' end as outcome from terms",
    "wn1_assigned_indexes": "select event_id, 1000 + row_number() over (order by event_id) as log_index, 4 as term from events",
    "se1_union_peers": f"with {_CHANGES} select coalesce(o.change, n.change) as change, coalesce(o.node_id, n.node_id) as node_id, case when n.node_id is null then 'a' else 'b' end as addr from o full join n on o.change = n.change and o.node_id = n.node_id where coalesce(o.node_id, n.node_id) <> 7",
    "jn13_target_changes": f"with {_CHANGES} select n.change, n.node_id, 'start' as action from n anti join o on o.change = n.change and o.node_id = n.node_id union all select o.change, o.node_id, 'stop' from o anti join n on o.change = n.change and o.node_id = n.node_id",
    "jn2_ack_verification": f"with {_LOG}, {_ACKS} select count(*) as total_acknowledged, count(*) filter (where verified) as verified_acknowledged, count(*) filter (where not verified) as verification_missing from checked",
    "jn2_verified_writes": f"with {_LOG}, {_ACKS} select key, value, phase, log_index, verified from checked",
    "ag23_ack_phases": f"with {_LOG}, {_ACKS} select phase, count(*) as acknowledged from acks group by 1",
}
