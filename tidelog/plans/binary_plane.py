"""Queries of the binary plane: events written in a file or wire format, read back, and held against SQL over `events`.

Reading verifies every checksum, length and marker, so equal rows mean that both directions of a format work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, crc32c, formats, rpc
from ..functions.labels import role_name
from ..operators import evidence, metrics, state, status
from ..sources import binary_files, sinks
from .files import fresh
from .oracles import _LIVE, _LOG, _OBS
from .protocol import _NODES, _events, _nodes, _pick, _sql_pick, e_, registering, u_
from .workloads import _log, _observations

QUERIES: dict = {}
SQL: dict[str, str] = {}


query = registering(QUERIES, SQL)


def _entries(s: SparkSession, d: str) -> DataFrame:
    """The log with encoded commands."""
    op = F.when(F.col("op") == "PUT", 1).otherwise(2)
    log = _log(s, d)
    command = binary.encode_command(op, F.coalesce("k", F.lit("")).cast("binary"), F.col("v").cast("string").cast("binary"))
    kind = F.when(F.col("log_index") % 97 == 0, 1).otherwise(0)
    return log.select("log_index", (F.floor(F.col("log_index") / 512) + 1).alias("term"), kind.alias("kind"), F.when(kind == 1, F.lit(b"")).otherwise(command).alias("command"))


_READ = f"""{_LOG}, e as (select log_index, log_index // 512 + 1 as term, case when log_index % 97 = 0 then 1 else 0 end as kind, k, v, op from log)"""
_DECODED = f"with {_READ} select log_index, term, kind, case when kind = 0 then case when op = 'PUT' then 1 else 2 end end as op, case when kind = 0 then k end as key, case when kind = 0 and op = 'PUT' then cast(v as varchar) when kind = 0 then '' end as value from e"


def _decoded(entries: DataFrame) -> DataFrame:
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    c = entries.select(whole("log_index"), whole("term"), F.col("kind").cast("int").alias("kind"), binary.decode_command(F.col("command")).alias("c"))
    return c.select("log_index", "term", "kind", F.col("c.op").cast("int").alias("op"), F.col("c.key").cast("string").alias("key"), F.col("c.value").cast("string").alias("value"))


@query(_DECODED)
def sc1_segmented_log(s, d):
    """The log as segments with a manifest, opened by its path: contiguity, names, batch ends and checksums are verified."""
    path = fresh(s, "log")
    sinks.write_segments(_entries(s, d), path, 3, most=16 << 10)
    return _decoded(binary_files.open_log(s, path))


@query("select event_id // 64 as segment, case when event_id // 64 % 3 = 1 then 'record' else 'fine' end as found, case when event_id // 64 % 3 = 1 then 0 else count(*) end as entries from events group by 1, 2")
def sc2_segment_records(s, d):
    """Segments of 64 entries, decoded where they are encoded; every third has a flipped bit in its last record's body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, commands in zip(b.column("segment").to_pylist(), b.column("commands").to_pylist(), strict=True):
                data = bytearray(formats.segment(n * 64 + 1, [[(1, 0, c)] for c in commands]))
                if n % 3 == 1:
                    data[30] ^= 1
                try:
                    start, entries, _ = formats.decode_segment(bytes(data))
                    out.append((n, "fine" if start == n * 64 + 1 and [e[2] for e in entries] == commands else "other", len(entries)))
                except formats.CorruptFile:
                    out.append((n, "record", 0))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["segment", "found", "entries"])

    groups = _events(s, d).groupBy(F.floor(e_() / 64).alias("segment")).agg(F.array_sort(F.collect_list(F.col("props").cast("binary"))).alias("commands"))
    return groups.mapInArrow(run, "segment bigint, found string, entries bigint")


@query(_DECODED)
def sc5_single_file_log(s, d):
    """The log as one file of the old layout; it has no segments, so the driver puts the pieces together."""
    path = fresh(s, "single")
    rows = _entries(s, d).orderBy("log_index").select("term", "kind", "command").toLocalIterator()
    sinks.put_chunks(s, path, _pieces(rows))
    return _decoded(binary_files.log_file(s, path))


def _pieces(rows) -> Iterator[bytes]:
    yield formats.log_file(0, 0, [])
    for r in rows:
        yield formats.record(int(r["term"]), int(r["kind"]), bytes(r["command"]))


@query("select 7 as generation, 128 as base_index, 3 as base_term, 4 as current_term, 5 as voted_for, max(event_id) as commit_index from events")
def sc6_metadata_files(s, d):
    """Manifest, term and vote, and commit index, written and read (SC6, SC11, SC12, FN10)."""
    root = fresh(s, "meta")
    commit = int(_events(s, d).agg(F.max("event_id")).first()[0] or 0)
    sinks.put_bytes(s, f"{root}/m", formats.manifest(7, 128, 3))
    sinks.put_bytes(s, f"{root}/s", formats.state_file(4, 5))
    sinks.put_bytes(s, f"{root}/c", formats.commit_file(commit))
    both = binary_files.manifest(s, f"{root}/m").join(binary_files.term_and_vote(s, f"{root}/s")).join(binary_files.commit_index(s, f"{root}/c"))
    return both.select(*[F.col(c).cast("bigint").alias(c) for c in both.columns])


@query(f"with {_LOG} select log_index - 1 as position, case when op = 'PUT' then 1 else 2 end as op, k as key, case when op = 'PUT' then cast(v as varchar) else '' end as value from log")
def sc7_wal(s, d):
    """Every command in a write-ahead log with a torn last record, read back."""
    path = fresh(s, "wal")
    rows = _log(s, d).select((F.col("log_index") - 1).alias("position"), F.when(F.col("op") == "PUT", 1).otherwise(2).alias("op"), F.col("k").cast("binary").alias("key"), F.coalesce(F.col("v").cast("string"), F.lit("")).cast("binary").alias("value"))
    sinks.write_wal(rows, path)
    torn = bytes(s.read.format("binaryFile").load(path).select("content").first()[0]) + formats.wal_record(1, b"k", b"v")[:-3]
    sinks.put_bytes(s, path, torn)
    got = binary_files.wal(s, path)
    return got.select("position", F.col("op").cast("int").alias("op"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _state(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    live = state.live(_log(s, d)).select(F.col("k").cast("binary").alias("key"), F.col("v").cast("string").cast("binary").alias("value"))
    e = _events(s, d).groupBy("user_id").agg(F.count("*").alias("last_seq"))
    ident = F.concat(binary.be(u_() + 1, 8), binary.be(F.lit(0), 8))
    return live, e.select(ident.alias("client_id"), "last_seq", F.unhex(F.sha2(u_().cast("string"), 256)).alias("last_fingerprint"), F.lit(1).alias("last_result"))


@query(f"with {_LOG}, st as ({_LIVE.format('log')}) select 'kv' as part, k as key, cast(v as varchar) as value from st union all select 'client', lpad(lower(to_hex(user_id + 1)), 16, '0') || repeat('0', 16), count(*) || ':' || sha256(cast(user_id as varchar)) from events group by user_id")
def sc10_kv_snapshot(s, d):
    """The state and the client records as a snapshot, both tables read back."""
    path = fresh(s, "kv")
    sinks.write_kv_snapshot(*_state(s, d), path)
    kv = binary_files.kv_snapshot(s, path).select(F.lit("kv").alias("part"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    own = binary_files.kv_snapshot(s, path, "clients")
    return kv.unionByName(own.select(F.lit("client").alias("part"), F.lower(F.hex("client_id")).alias("key"), F.concat_ws(":", F.col("last_seq").cast("bigint").cast("string"), F.lower(F.hex("last_fingerprint"))).alias("value")))


@query(f"with {_LOG}, st as ({_LIVE.format('log')}) select 'snap' as file, 90 as last_index, 4 as last_term, '1=a:1,2=b:2' as voters, count(*) as entries, cast(null as varchar) as error from st union all select 'bad', null, null, null, null, 'checksum mismatch'")
def sc9_snapshot_file(s, d):
    """A snapshot file with a configuration, read back, and a broken one, which quarantine gives as a row."""
    root = fresh(s, "snap")
    sinks.write_snapshot_file(*_state(s, d), f"{root}/snap", 90, 4, {2: "b:2", 1: "a:1"})
    whole = bytearray(s.read.format("binaryFile").load(f"{root}/snap").select("content").first()[0])
    whole[40] ^= 1
    sinks.put_bytes(s, f"{root}/bad", bytes(whole))
    head = binary_files.snapshot_file(s, f"{root}/snap")
    voters = F.array_join(F.transform("configuration", lambda v: F.concat_ws("=", v["node_id"].cast("string"), v["addr"])), ",")
    # The payload's own count of entries stands behind its version byte.
    entries = binary.unsigned(F.substring("data", 2, 4)).cast("bigint")
    good = head.select(F.lit("snap").alias("file"), F.col("last_included_index").cast("bigint").alias("last_index"), F.col("last_included_term").cast("bigint").alias("last_term"), voters.alias("voters"), entries.alias("entries"), F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = binary_files.snapshot_file(s, f"{root}/bad", quarantine=True).select(F.lit("bad").alias("file"), none("bigint").alias("last_index"), none("bigint").alias("last_term"), none("string").alias("voters"), none("bigint").alias("entries"), "error")
    return good.unionByName(bad)


@query("select event_id, length(event_type) as size, true as agrees from events")
def fn2_crc32c(s, d):
    """Checksums of every event's type, side by side and byte by byte; the two must agree."""

    @F.pandas_udf("bigint")
    def slowly(x):
        return x.map(lambda b: crc32c.crc32c(bytes(b)))

    data = F.col("event_type").cast("binary")
    return _events(s, d).select("event_id", F.octet_length(data).alias("size"), (crc32c.crc32c_column(data) == slowly(data)).alias("agrees"))


def _ident() -> Column:
    return F.concat(binary.be(u_() + 1, 8), binary.be(F.lit(0), 8))


@query(
    """select event_id, 1 + event_id % 3 as operation, case when event_id % 3 = 1 then 0 else event_id + 1 end as seq, event_type as key, case when event_id % 3 = 0 then cast(user_id as varchar) else '' end as value,
 cast(null as varchar) as error, event_id % 9 + 1 as status, case when event_id % 9 = 2 then 'host' else '' end as hint from events"""
)
def fn5_request_response(s, d):
    op = e_() % 3 + 1
    reads = e_() % 3 == 1
    request = binary.encode_request(op, F.when(~reads, _ident()), F.when(~reads, e_() + 1), F.col("event_type").cast("binary"), F.when(e_() % 3 == 0, u_().cast("string").cast("binary")))
    response = binary.encode_response(e_() % 9 + 1, F.when(e_() % 9 == 2, F.lit(b"host")), F.col("event_type").cast("binary"))
    raw = _events(s, d).select("event_id", request.alias("q"), response.alias("a"))
    got = raw.select("event_id", binary.decode_request(F.col("q")).alias("q"), binary.decode_response(F.col("a")).alias("a"))
    text = lambda c: F.col(c).cast("string")
    return got.select("event_id", F.col("q.operation").cast("int").alias("operation"), F.col("q.seq").cast("bigint").alias("seq"), text("q.key").alias("key"), text("q.value").alias("value"), F.coalesce("q.error", "a.error").alias("error"), F.col("a.status").cast("int").alias("status"), text("a.leader_hint").alias("hint"))


@query(
    """select event_id, case when event_id % 4 = 0 and event_id % 3 = 1 then 'identity on a read' when event_id % 4 = 0 then 'value not allowed' when event_id % 4 = 1 and event_id % 3 <> 1 then 'client id required'
 when event_id % 4 = 2 and event_id % 3 <> 1 then 'sequence required' when event_id % 4 = 2 or event_id % 4 = 3 and event_id % 3 = 1 then 'identity on a read' end as error from events where not (event_id % 4 = 0 and event_id % 3 = 0)"""
)
def va2_identity_rules(s, d):
    """Writes without an identity or number, reads with one, and values where none may be."""
    op = e_() % 3 + 1
    client = F.when(e_() % 4 == 1, F.lit(binary.ZERO_ID)).otherwise(_ident())
    seq = F.when(e_() % 4 == 2, 0).when(e_() % 4 == 1, F.when(e_() % 3 == 1, 0).otherwise(e_() + 1)).otherwise(e_() + 1)
    value = F.when(e_() % 4 == 0, F.lit(b"x")).otherwise(F.lit(b""))
    return _events(s, d).filter(~((e_() % 4 == 0) & (e_() % 3 == 0))).select("event_id", binary.request_errors(op, client, seq, value).alias("error"))


@query(
    """select event_id, case event_id % 6 when 1 then 'length mismatch' when 2 then 'unsupported version' when 3 then 'unknown operation' when 4 then 'too short' when 5 then 'length out of bounds' end as error,
 case when event_id % 6 = 0 then event_type end as key from events"""
)
def va1_rejections(s, d):
    """Commands that are cut, of another version or operation, empty, or of an impossible length."""
    good = binary.encode_command(F.lit(1), F.col("event_type").cast("binary"), F.lit(b"v"))
    rest = lambda n: F.substring(F.col("b"), n + 1, 1000)
    broken = (
        F.when(e_() % 6 == 1, F.substring(F.col("b"), F.lit(1), F.octet_length("b") - 1))
        .when(e_() % 6 == 2, F.concat(F.lit(b"\x09"), rest(1)))
        .when(e_() % 6 == 3, F.concat(F.lit(b"\x01\x07"), rest(2)))
        .when(e_() % 6 == 4, F.lit(b""))
        .when(e_() % 6 == 5, F.concat(F.lit(b"\x01\x01\xff\xff\xff\xff"), rest(6)))
        .otherwise(F.col("b"))
    )
    got = _events(s, d).select("event_id", good.alias("b")).select("event_id", binary.decode_command(broken).alias("c"))
    return got.select("event_id", "c.error", F.col("c.key").cast("string").alias("key"))


@query(
    """select event_id, case when event_id % 10 = 9 then 'unknown operation' end as error, case when event_id % 10 <> 9 then event_id % 5 + 1 end as operation, case when event_id % 10 <> 9 then user_id end as target,
 case when event_id % 10 <> 9 then event_id end as voter, case when event_id % 10 <> 9 then event_type end as addr from events"""
)
def fn6_admin_requests(s, d):
    op = F.when(e_() % 10 == 9, 6).otherwise(e_() % 5 + 1)
    raw = _events(s, d).select("event_id", rpc.encode_admin_request(op, u_(), e_(), F.col("event_type").cast("binary")).alias("b"))
    got = raw.select("event_id", rpc.decode_admin_request(F.col("b")).alias("q"))
    return got.select("event_id", "q.error", "q.operation", F.col("q.transfer_target").cast("bigint").alias("target"), F.col("q.voter_id").cast("bigint").alias("voter"), F.col("q.voter_addr").cast("string").alias("addr"))


@query(
    f"""with {_NODES} select node_id, case when u % 13 = 12 then 'trailing bytes' end as error, case when u % 13 <> 12 then u % 11 + 1 end as status, case when u % 13 <> 12 then 'hint' end as hint, case when u % 13 <> 12 then term end as term,
 case when u % 13 <> 12 then commit_index end as commit_index, case when u % 13 <> 12 then (u + 3) || '=h:3,' || (u + 1) || '=h:1' end as stable, case when u % 13 = 12 then null when u % 2 = 0 then (u + 2) || '=h:2,' || (u + 1) || '=h:1' else '' end as old from f"""
)
def fn6_admin_responses(s, d):
    """Status answers with lists of voters; some have a byte too many."""
    nodes = _nodes(s, d)
    info = {"node_id": F.col("node_id"), "role": F.col("role") + 1, "term": F.col("current_term"), "leader_id": F.coalesce("leader_id", F.lit(0)), "last_log_index": F.col("last_log_index"), "commit_index": F.col("commit_index"), "last_applied": F.lit(0), "mode": F.col("mode")}
    wire = lambda c: F.transform(c, lambda v: F.struct(v["id"].alias("id"), v["addr"].cast("binary").alias("addr")))
    b = rpc.encode_admin_response(F.col("node_id") % 11 + 1, F.lit(b"hint"), info, stable_voters=wire(F.col("voters")), old_voters=F.when(F.col("node_id") % 2 == 0, wire(F.col("old_voters"))))
    raw = nodes.select("node_id", F.when(F.col("node_id") % 13 == 12, F.concat(b, F.lit(b"\0"))).otherwise(b).alias("b"))
    got = raw.select("node_id", rpc.decode_admin_response(F.col("b")).alias("a"))
    shown = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda v: F.concat_ws("=", v["id"].cast("string"), v["addr"].cast("string"))), ","))
    return got.select("node_id", "a.error", "a.status", F.col("a.leader_hint").cast("string").alias("hint"), F.col("a.term").cast("bigint").alias("term"), F.col("a.commit_index").cast("bigint").alias("commit_index"), shown("a.stable_voters").alias("stable"), shown("a.old_voters").alias("old"))


@query(
    """select event_id, case when event_id % 7 = 6 then 'truncated command' when event_id % 7 = 5 then 'trailing bytes' end as error, case when event_id % 7 < 5 then event_id // 512 + 1 end as term, case when event_id % 7 < 5 then event_id end as prev,
 case when event_id % 7 >= 5 then null when event_id % 4 = 0 then '' else '3:0:' || event_type || case when event_id % 4 > 1 then ',4:1:' else '' end || case when event_id % 4 > 2 then ',4:2:' || user_id else '' end end as entries from events"""
)
def fn7_append_calls(s, d):
    """Append calls of up to three entries; some are cut or have a byte too many."""
    one = lambda t, k, c: F.struct(F.lit(t).alias("term"), F.lit(k).alias("kind"), c.alias("command"))
    some = F.slice(F.array(one(3, 0, F.col("event_type").cast("binary")), one(4, 1, F.lit(b"")), one(4, 2, u_().cast("string").cast("binary"))), F.lit(1), (e_() % 4).cast("int"))
    # a broken call has all three entries
    entries = F.when(e_() % 7 < 5, some).otherwise(F.array(one(3, 0, F.col("event_type").cast("binary")), one(4, 1, F.lit(b"")), one(4, 2, u_().cast("string").cast("binary"))))
    b = rpc.encode_append(entries, term=F.floor(e_() / 512) + 1, leader_id=F.lit(2), prev_log_index=e_(), prev_log_term=F.lit(1), leader_commit=F.lit(0), read_context=F.lit(9))
    raw = _events(s, d).select("event_id", b.alias("b"))
    cut = F.when(e_() % 7 == 6, F.substring(F.col("b"), F.lit(1), F.octet_length("b") - 1)).when(e_() % 7 == 5, F.concat("b", F.lit(b"x"))).otherwise(F.col("b"))
    got = raw.select("event_id", rpc.decode_append(cut).alias("q"))
    shown = F.when(F.col("q.error").isNull(), F.array_join(F.transform("q.entries", lambda e: F.concat_ws(":", e["term"].cast("string"), e["kind"].cast("string"), e["command"].cast("string"))), ","))
    return got.select("event_id", "q.error", F.col("q.term").cast("bigint").alias("term"), F.col("q.prev_log_index").cast("bigint").alias("prev"), shown.alias("entries"))


@query(
    """select event_id, 'vote' as call, case when event_id % 5 = 0 then 'length' end as error, case when event_id % 5 <> 0 then event_id || ',' || user_id || ',7,8' end as fields from events
union all select event_id, 'vote answer', case when event_id % 5 = 0 then 'length' end, case when event_id % 5 <> 0 then event_id || ',' || (event_id % 2 = 0) end from events
union all select event_id, 'timeout now', case when event_id % 5 = 0 then 'length' end, case when event_id % 5 <> 0 then event_id || ',' || user_id end from events
union all select event_id, 'append answer', case when event_id % 5 = 0 then 'length' end, case when event_id % 5 <> 0 then event_id || ',' || (event_id % 2 = 0) || ',' || user_id || ',3' end from events"""
)
def fn7_fixed_calls(s, d):
    """Votes, orders to campaign and answers; every fifth is cut by a byte."""
    yes = e_() % 2 == 0
    calls = {
        "vote": (rpc.encode_vote(term=e_(), candidate_id=u_(), last_log_index=F.lit(7), last_log_term=F.lit(8)), rpc.decode_vote, ("term", "candidate_id", "last_log_index", "last_log_term")),
        "vote answer": (rpc.encode_vote_response(term=e_(), granted=yes), rpc.decode_vote_response, ("term", "granted")),
        "timeout now": (rpc.encode_timeout_now(term=e_(), leader_id=u_()), rpc.decode_timeout_now, ("term", "leader_id")),
        "append answer": (rpc.encode_append_response(term=e_(), success=yes, match_index=u_(), read_context=F.lit(3)), rpc.decode_append_response, ("term", "success", "match_index", "read_context")),
    }
    out = None
    for name, (raw, decode, fields) in calls.items():
        got = _events(s, d).select("event_id", raw.alias("b"))
        got = got.select("event_id", decode(F.when(e_() % 5 == 0, F.substring(F.col("b"), F.lit(1), F.octet_length("b") - 1)).otherwise(F.col("b"))).alias("q"))
        shown = F.when(F.col("q.error").isNull(), F.concat_ws(",", *[F.col(f"q.{f}").cast("string") for f in fields]))
        rows = got.select("event_id", F.lit(name).alias("call"), "q.error", shown.alias("fields"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select event_id, case when event_id % 4 = 3 then 'configuration isn''t stable' end as error, case when event_id % 4 <> 3 then event_type end as data, case when event_id % 4 <> 3 then event_id % 2 = 0 end as done, case when event_id % 4 <> 3 then event_id * 10 end as offset from events")
def fn7_snapshot_chunks(s, d):
    stable, joint = formats.membership(formats.Membership(stable={1: "a"})), formats.membership(formats.Membership(old={1: "a"}, new={2: "b"}))
    b = rpc.encode_install(e_() % 2 == 0, F.col("event_type").cast("binary"), F.when(e_() % 4 == 3, F.lit(joint)).otherwise(F.lit(stable)), term=F.lit(1), leader_id=F.lit(2), last_included_index=F.lit(3), last_included_term=F.lit(1), offset=e_() * 10)
    got = _events(s, d).select("event_id", b.alias("b")).select("event_id", rpc.decode_install(F.col("b")).alias("q"))
    return got.select("event_id", "q.error", F.col("q.data").cast("string").alias("data"), "q.done", F.col("q.offset").cast("bigint").alias("offset"))


@query("select event_id as log_index, case when event_id % 2 = 0 then 1 else 2 end as mode, case when event_id % 2 = 0 then '1=a,' || (user_id + 2) || '=b' end as stable, case when event_id % 2 = 1 then '1=a' end as old, case when event_id % 2 = 1 then '1=a,' || (user_id + 2) || '=b' end as new from events where event_id % 5 <> 4")
def fn8_memberships(s, d):
    """Configuration entries encoded and decoded; what can't be decoded takes no effect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, u in zip(b.column("log_index").to_pylist(), b.column("u").to_pylist(), strict=True):
                two = {u + 2: "b", 1: "a"}
                m = formats.Membership(stable=two) if i % 2 == 0 else formats.Membership(old={1: "a"}, new=two)
                out.append(formats.membership(m)[: -1 if i % 5 == 4 else None])
            yield pa.record_batch([b.column("log_index"), pa.array(out, pa.binary())], names=["log_index", "command"])

    entries = _events(s, d).select(e_().alias("log_index"), u_().alias("u")).mapInArrow(run, "log_index bigint, command binary").withColumn("kind", F.lit(2))
    got = binary_files.memberships(entries)
    shown = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws("=", v["node_id"].cast("string"), v["addr"])), ",")
    return got.select(F.col("log_index").cast("bigint").alias("log_index"), F.col("mode").cast("int").alias("mode"), shown("stable").alias("stable"), shown("old_voters").alias("old"), shown("new_voters").alias("new"))


@query("select event_id, lower(hex(event_type || user_id)) as client_id, event_id % 3 = 0 as zero from events")
def fn11_client_ids(s, d):
    made = F.when(e_() % 3 == 0, F.lit(binary.ZERO_ID)).otherwise(binary.new_client_id())
    raw = _events(s, d).select("event_id", made.alias("id"), F.concat(F.col("event_type"), u_().cast("string")).cast("binary").alias("b"))
    known = state.identified(F.col("id"))
    return raw.select("event_id", binary.client_id_hex(F.col("b")).alias("client_id"), (~known & (F.octet_length("id") == 16)).alias("zero"))


# Text files.


@query("select event_type || '-' || event_id as key, cast(user_id as varchar) as value, case when event_id % 2 = 0 then 'before' else 'after' end as phase from events")
def sc13_acknowledged(s, d):
    """Acknowledged writes appended as lines of JSON in two runs, read back."""
    path = fresh(s, "acks")
    rows = _events(s, d).select(F.concat_ws("-", "event_type", e_().cast("string")).alias("key"), u_().cast("string").alias("value"), F.when(e_() % 2 == 0, "before").otherwise("after").alias("phase"))
    for phase in ("before", "after"):
        sinks.append_json(rows.filter(F.col("phase") == phase), path)
    return binary_files.acknowledged(s, path)


@query("select event_id as path, sha256(event_type) as digest, case when event_id % 10 = 0 then sha256('other') end as actual from events where event_id % 10 = 0 or event_id % 7 = 0 and event_id % 10 <> 0")
def jn11_checksum_mismatches(s, d):
    """A checksum list of every event's type, held against files of which some differ and some are missing."""
    rows = _events(s, d)
    listed = sinks.checksum_lines(rows.select(e_().cast("string").alias("path"), F.col("event_type").cast("binary").alias("content")))
    there = rows.filter(~((e_() % 7 == 0) & (e_() % 10 != 0)))
    files = there.select(e_().cast("string").alias("path"), F.when(e_() % 10 == 0, "other").otherwise(F.col("event_type")).cast("binary").alias("content"))
    found = evidence.checksum_mismatches(evidence.checksums(listed.withColumnRenamed("line", "value")), files)
    return found.select(F.col("path").cast("bigint").alias("path"), "digest", "actual")


_NAMES = ("node_started", "other", "election_started", "leader_elected", "noise")


@query(f"with l as (select event_id as line_no, user_id as node_id, {_sql_pick('event_id', _NAMES)} as event from events), r as (select *, row_number() over (partition by node_id order by line_no desc) as rn from l where event not in ('other', 'noise')) select line_no, node_id, event, '<data>/n' as path from r where rn <= 120")
def pr15_relevant_log(s, d):
    """The last listed events of every node's log, paths replaced."""
    line = F.to_json(F.struct(_pick(e_(), _NAMES).alias("event"), F.lit("/srv/data/n").alias("path")))
    lines = _events(s, d).select(e_().alias("line_no"), u_().alias("node_id"), line.alias("value"))
    kept = evidence.relevant_log(lines, {"/srv/data": "<data>"})
    return kept.select("line_no", "node_id", F.get_json_object("value", "$.event").alias("event"), F.get_json_object("value", "$.path").alias("path"))


@query("select event_type as event, user_id as node_id, event_id as term from events")
def sc18_event_rows(s, d):
    """Structured log lines written as text, read back."""
    path = fresh(s, "events")
    rows = _events(s, d).select(F.lit("INFO").alias("level"), F.col("event_type").alias("event"), u_().alias("node_id"), e_().alias("term"))
    sinks.write_text(status.event_lines(rows), path)
    return evidence.event_rows(s, path).select("event", "node_id", "term")


@query("select event_id, user_id as total, event_type as phase from events")
def sk13_stats_json(s, d):
    """Statistics replaced as a whole, read back."""
    path = fresh(s, "stats")
    for extra in (1, 0):  # the second write replaces the first one
        sinks.write_json(_events(s, d).select("event_id", (u_() + extra).alias("total"), F.col("event_type").alias("phase")), path)
    return s.read.schema("event_id bigint, total bigint, phase string").json(path)


@query(f"with {_LOG}, st as ({_LIVE.format('log')}) select k, v, log_index from st")
def sk3_published_state(s, d):
    """The state published in three generations, each over more of the log; the current one is read."""
    root = fresh(s, "state")
    log = _log(s, d)
    for at in (100, 500, None):
        sinks.publish(state.live(log if at is None else log.filter(F.col("log_index") <= at)).select("k", "v", "log_index"), root)
    return sinks.current(s, root)


@query(f"with {_LOG}, st as ({_LIVE.format('log')}) select row_number() over (order by encode(k)) as place, k, v from st")
def so1_byte_order(s, d):
    """Keys in byte order with their places."""
    from pyspark.sql import Window as W

    ordered = state.ordered_snapshot(state.live(_log(s, d)).select(F.col("k").cast("binary").alias("k"), "v"))
    return ordered.select(F.row_number().over(W.orderBy("k")).alias("place"), F.col("k").cast("string").alias("k"), "v")


# Metrics in text.


def _exposition(s: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(s, d)
    snap = nodes.select("node_id", F.col("current_term").alias("term"), role_name(F.col("role")).alias("role"), F.col("commit_index").alias("raft_commit_index"), F.col("snapshot_term").alias("raft_elections_total"))
    peers = nodes.crossJoin(F.broadcast(s.range(9, 12).select(F.col("id").alias("peer")))).select("node_id", "peer", "last_log_index", (F.col("last_log_index") - F.col("peer")).alias("match"), (F.col("last_log_index") + 1).alias("next"), F.lit(1).alias("rpcs"), F.lit(2).alias("bytes"), F.lit(3).alias("failures"), F.lit(4).alias("stale"))
    obs = _observations(s, d).withColumnRenamed("user_id", "node_id")
    requests = metrics.requests_total(obs, ("node_id",))
    known = obs.filter("operation <> 'scan'")
    h = metrics.histogram(known, F.col("duration_ns") / 1e9, ("node_id", "operation"))
    t = metrics.histogram_totals(known, F.col("duration_ns"), ("node_id", "operation"))
    return status.exposition(snap, peers, requests, {"request_duration_seconds": (h, t, "operation")}, "x_")


@query(
    f"""with {_NODES}, {_OBS}, o as (select user_id, operation, case when status in ('ok', 'busy', 'not_found') then status else 'internal' end as status, duration_ns from obs where operation <> 'scan')
select node_id, 'x_raft_term' as metric, '' as labels, cast(term as double) as value from f union all select node_id, 'x_raft_commit_index', '', commit_index from f union all select node_id, 'x_raft_elections_total', '', snapshot_term from f
union all select node_id, 'x_raft_role', 'role=' || r, (r = role)::int from f cross join (values ('leader'), ('follower'), ('candidate')) t(r)
union all select node_id, 'x_raft_peer_match_index', 'peer=' || p, last_log_index - p from f cross join (values (9), (10), (11)) t(p) union all select node_id, 'x_raft_peer_replication_lag', 'peer=' || p, p from f cross join (values (9), (10), (11)) t(p)
union all select user_id, 'x_requests_total', 'operation=' || operation || ',status=' || status, count(*) from o group by user_id, operation, status
union all select user_id, 'x_request_duration_seconds_count', 'operation=' || operation, count(*) from o group by user_id, operation
union all select user_id, 'x_request_duration_seconds_bucket', 'le=0.001,operation=' || operation, count(*) filter (where duration_ns <= 1000000) from o group by user_id, operation"""
)
def sk11_exposition(s, d):
    """The whole exposition of every node as text, parsed again: the families that SQL states, zero request counts aside."""
    lines = _exposition(s, d)
    back = metrics.parse_exposition(lines.select("node_id", "line"), "line", ("node_id",))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    flat = back.select("node_id", "metric", shown.alias("labels"), "value")
    wanted = ("x_raft_term", "x_raft_commit_index", "x_raft_elections_total", "x_raft_role", "x_raft_peer_match_index", "x_raft_peer_replication_lag", "x_request_duration_seconds_count")
    return flat.filter(F.col("metric").isin(*wanted) | ((F.col("metric") == "x_requests_total") & (F.col("value") > 0)) | ((F.col("metric") == "x_request_duration_seconds_bucket") & F.col("labels").startswith("le=0.001,")))


@query(f"with {_NODES}, l as (select node_id, unnest(['9', '10', '11']) as peer, unnest([1, 2, 3]) as place from f) select node_id, peer, place from l")
def so5_peer_order(s, d):
    """The place of each peer's lines in a node's exposition: by number, not by text."""
    from pyspark.sql import Window as W

    lines = _exposition(s, d).filter(F.col("line").startswith("x_raft_peer_match_index"))
    return lines.select("node_id", F.regexp_extract("line", r'peer="([0-9]+)"', 1).alias("peer"), F.row_number().over(W.partitionBy("node_id").orderBy("ord")).alias("place"))


@query("with s as (select (event_id // 500) * 500 as start_index, count(*) as entries from events group by 1) select row_number() over (order by start_index) as place, start_index + 1 as start_index from s")
def so4_segment_order(s, d):
    """Segment files of 500 entries each, in the order of their names."""
    from pyspark.sql import Window as W

    path = fresh(s, "order")
    for r in _events(s, d).groupBy((F.floor(e_() / 500) * 500 + 1).alias("start")).agg(F.count("*").alias("n")).toLocalIterator():
        sinks.put_bytes(s, f"{path}/{formats.segment_name(r['start'])}", formats.segment(r["start"], [[(1, 1, b"")] * r["n"]]))
    files = binary_files.segment_files(s, path)
    return files.select(F.row_number().over(W.orderBy("name")).alias("place"), "start_index")
