"""Payloads of the administration and replication calls as column expressions, for captures and fixtures.

As in `binary`, every decoder gives a struct whose `error` is null for a valid payload. Lists are bounded by their format
(31 voters, 64 entries), so folding them in an array is bounded work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ADMIN_OPERATIONS, ADMIN_STATUS, MAX_ADDRESS, MAX_CHUNK, MAX_COMMAND, MAX_ENTRIES, MAX_VOTERS
from .binary import _byte, _first, _or_empty, be, part, unsigned

VOTERS = "array<struct<id:decimal(20,0),addr:binary>>"
ENTRIES = "array<struct<term:decimal(20,0),kind:int,command:binary>>"


def _good(error: Column, value: Column) -> Column:
    return F.when(error.isNull(), value)


def _numbers(data: Column, names: tuple[str, ...]) -> list[Column]:
    """Eight-byte numbers one after the other from the start."""
    return [unsigned(part(data, 8 * i, 8)).alias(n) for i, n in enumerate(names)]


def fixed(names: tuple[str, ...], flag: str | None = None, after: tuple[str, ...] = ()):
    """(encode, decode) of a payload of eight-byte numbers, a flag byte, and more numbers."""
    size = 8 * (len(names) + len(after)) + (flag is not None)
    at = 8 * len(names)

    def encode(**values: Column) -> Column:
        parts = [be(values[n], 8) for n in names]
        if flag:
            parts.append(be(F.when(values[flag], 1).otherwise(0), 1))
        return F.concat(*parts, *[be(values[n], 8) for n in after])

    def decode(data: Column) -> Column:
        tests = [(data.isNull() | (F.octet_length(data) != size), "length")]
        if flag:
            tests.append((_byte(data, at) > 1, f"invalid {flag}"))
        error = _first(*tests)
        out = [unsigned(part(data, 8 * i, 8)) for i in range(len(names))]
        late = [unsigned(part(data, at + 1 + 8 * i, 8)) for i in range(len(after))]
        shown = [_good(error, c).alias(n) for n, c in zip((*names, *after), (*out, *late), strict=True)]
        return F.struct(error.alias("error"), *shown, *([_good(error, _byte(data, at) == 1).alias(flag)] if flag else []))

    return encode, decode


#: The field orders of the calls.
encode_vote, decode_vote = fixed(("term", "candidate_id", "last_log_index", "last_log_term"))
encode_vote_response, decode_vote_response = fixed(("term",), "granted")
encode_pre_vote, decode_pre_vote = fixed(("prospective_term", "candidate_id", "last_log_index", "last_log_term"))
encode_timeout_now, decode_timeout_now = fixed(("term", "leader_id"))
encode_timeout_now_response, decode_timeout_now_response = fixed(("term",), "accepted")
encode_append_response, decode_append_response = fixed(("term",), "success", ("match_index", "read_context"))
encode_install_response, decode_install_response = fixed(("term",), "success", ("next_offset",))
APPEND_HEAD = ("term", "leader_id", "prev_log_index", "prev_log_term", "leader_commit", "read_context")
INSTALL_HEAD = ("term", "leader_id", "last_included_index", "last_included_term", "offset")


def encode_append(entries: Column, **head: Column) -> Column:
    """An append call; `entries` is an array of struct(term, kind, command)."""
    each = F.transform(entries, lambda e: F.concat(be(e["term"], 8), be(e["kind"], 1), be(F.octet_length(_or_empty(e["command"])), 4), _or_empty(e["command"])))
    body = F.aggregate(each, F.lit(b""), lambda a, x: F.concat(a, x))
    return F.concat(*[be(head[n], 8) for n in APPEND_HEAD], be(F.size(entries), 4), body)


def decode_append(data: Column) -> Column:
    """struct(error, head..., entries)."""
    size = F.octet_length(data)
    count = unsigned(part(data, 48, 4)).cast("int")
    start = F.struct(F.lit(52).alias("at"), F.lit(None).cast("string").alias("error"), F.array().cast(ENTRIES).alias("list"))

    def step(a: Column, _: Column) -> Column:
        at = a["at"]
        kind, length = unsigned(part(data, at + 8, 1)).cast("int"), unsigned(part(data, at + 9, 4)).cast("int")
        error = F.coalesce(
            a["error"],
            _first((at + 13 > size, "truncated entry header"), (~kind.isin(0, 1, 2), "unknown entry kind"), (length > MAX_COMMAND, "command too long"), (at + 13 + length > size, "truncated command")),
        )
        one = F.struct(unsigned(part(data, at, 8)).alias("term"), kind.alias("kind"), part(data, at + 13, length).alias("command"))
        more = F.when(error.isNull(), F.array_append(a["list"], one)).otherwise(a["list"])
        return F.struct(F.when(error.isNull(), at + 13 + length).otherwise(at).alias("at"), error.alias("error"), more.alias("list"))

    early = _first((data.isNull() | (size < 52), "too short"), (count > MAX_ENTRIES, "too many entries"))
    steps = F.when(early.isNull() & (count > 0), F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(steps, start, step)
    error = F.coalesce(early, walked["error"], _first((walked["at"] != size, "trailing bytes")))
    head = [_good(error, unsigned(part(data, 8 * i, 8))).alias(n) for i, n in enumerate(APPEND_HEAD)]
    return F.struct(error.alias("error"), *head, _good(error, walked["list"]).alias("entries"))


def encode_install(done: Column, data: Column, configuration: Column, **head: Column) -> Column:
    """A snapshot chunk; `configuration` is an encoded stable membership."""
    data = _or_empty(data)
    return F.concat(*[be(head[n], 8) for n in INSTALL_HEAD], be(F.when(done, 1).otherwise(0), 1), be(F.octet_length(data), 4), data, be(F.octet_length(configuration), 8), configuration)


def decode_install(payload: Column) -> Column:
    """struct(error, head..., done, data, configuration): the configuration stays encoded, see `formats.decode_membership`."""
    size = F.octet_length(payload)
    length = unsigned(part(payload, 41, 4)).cast("int")
    tail = F.lit(45) + length
    config = unsigned(part(payload, tail, 8)).cast("bigint")
    body = part(payload, tail + 8, config)
    error = _first(
        (payload.isNull() | (size < 45), "too short"),
        (_byte(payload, 40) > 1, "invalid done"),
        (length > MAX_CHUNK, "chunk too long"),
        (tail + 8 > size, "length mismatch"),
        (size - tail - 8 < config, "truncated configuration"),
        ((F.octet_length(body) < 2) | (unsigned(part(body, 1, 1)) != 1), "configuration isn't stable"),
        (size != tail + 8 + config, "trailing bytes"),
    )
    head = [_good(error, unsigned(part(payload, 8 * i, 8))).alias(n) for i, n in enumerate(INSTALL_HEAD)]
    return F.struct(error.alias("error"), *head, _good(error, _byte(payload, 40) == 1).alias("done"), _good(error, part(payload, 45, length)).alias("data"), _good(error, body).alias("configuration"))


def encode_admin_request(operation: Column, target: Column, voter_id: Column, addr: Column) -> Column:
    addr = _or_empty(addr)
    return F.concat(F.lit(b"\x01"), be(operation, 1), be(F.coalesce(target, F.lit(0)), 8), be(F.coalesce(voter_id, F.lit(0)), 8), be(F.octet_length(addr), 2), addr)


def decode_admin_request(data: Column) -> Column:
    """struct(error, operation, transfer_target, voter_id, voter_addr)."""
    size, op, length = F.octet_length(data), _byte(data, 1), unsigned(part(data, 18, 2)).cast("int")
    error = _first(
        (data.isNull() | (size < 20), "too short"),
        (_byte(data, 0) != 1, "unsupported version"),
        (~op.isin(*ADMIN_OPERATIONS), "unknown operation"),
        (length > MAX_ADDRESS, "address too long"),
        (size != 20 + length, "length mismatch"),
    )
    return F.struct(
        error.alias("error"),
        _good(error, op).alias("operation"),
        _good(error, unsigned(part(data, 2, 8))).alias("transfer_target"),
        _good(error, unsigned(part(data, 10, 8))).alias("voter_id"),
        _good(error, part(data, 20, length)).alias("voter_addr"),
    )


#: The fields of a status answer behind its hint, with their widths.
INFO = (("snapshot_index", 8), ("snapshot_term", 8), ("node_id", 8), ("role", 1), ("term", 8), ("leader_id", 8), ("last_log_index", 8), ("commit_index", 8), ("last_applied", 8), ("info_snapshot_index", 8), ("info_snapshot_term", 8), ("mode", 1))
LISTS = ("stable_voters", "old_voters", "new_voters")


def _voter_list(voters: Column) -> Column:
    voters = F.coalesce(voters, F.array().cast("array<struct<id:bigint,addr:binary>>"))
    each = F.transform(voters, lambda v: F.concat(be(v["id"], 8), be(F.octet_length(v["addr"]), 2), v["addr"]))
    return F.concat(be(F.size(voters), 1), F.aggregate(each, F.lit(b""), lambda a, x: F.concat(a, x)))


def encode_admin_response(status: Column, hint: Column, info: dict[str, Column], **voters: Column) -> Column:
    """An administration answer. Fields of `info` that are missing are 0, but for the role (follower) and mode (stable); voters are lists of struct(id, addr)."""
    hint = _or_empty(hint)
    usual = {"role": F.lit(1), "mode": F.lit(1)}
    fields = [be(info.get(n, usual.get(n, F.lit(0))), w) for n, w in INFO]
    nothing = F.lit(None).cast("array<struct<id:bigint,addr:binary>>")
    return F.concat(F.lit(b"\x01"), be(status, 1), be(F.octet_length(hint), 2), hint, *fields, *[_voter_list(voters.get(n, nothing)) for n in LISTS])


def decode_admin_response(data: Column) -> Column:
    """struct(error, status, leader_hint, fields of INFO..., stable_voters, old_voters, new_voters)."""
    size, status, hint = F.octet_length(data), _byte(data, 1), unsigned(part(data, 2, 2)).cast("int")
    base = F.lit(4) + hint
    fields, ahead = {}, 0
    for n, w in INFO:
        fields[n] = unsigned(part(data, base + ahead, w))
        ahead += w

    # Three lists one after the other: a step reads a list's length byte or one of its voters.
    start = F.struct((base + ahead).alias("at"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("left"), F.array().cast(f"array<{VOTERS}>").alias("done"), F.array().cast(VOTERS).alias("now"))

    def voter(a: Column, _: Column) -> Column:
        at, length = a["at"], unsigned(part(data, a["at"] + 8, 2)).cast("int")
        error = F.coalesce(a["error"], _first((at + 10 > size, "truncated voter"), (length > MAX_ADDRESS, "address too long"), (at + 10 + length > size, "truncated voter address")))
        one = F.struct(unsigned(part(data, at, 8)).alias("id"), part(data, at + 10, length).alias("addr"))
        good = error.isNull()
        return F.struct(F.when(good, at + 10 + length).otherwise(at).alias("at"), error.alias("error"), a["left"].alias("left"), a["done"].alias("done"), F.when(good, F.array_append(a["now"], one)).otherwise(a["now"]).alias("now"))

    def voters(a: Column, _: Column) -> Column:
        count = unsigned(part(data, a["at"], 1)).cast("int")
        error = F.coalesce(a["error"], _first((a["at"] >= size, "truncated voter list"), (count > MAX_VOTERS, "too many voters")))
        steps = F.when(error.isNull() & (count > 0), F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        fresh = F.struct((a["at"] + 1).alias("at"), error.alias("error"), F.coalesce(count, F.lit(0)).alias("left"), a["done"].alias("done"), F.array().cast(VOTERS).alias("now"))
        read = F.aggregate(steps, fresh, voter)
        return F.struct(read["at"].alias("at"), read["error"].alias("error"), F.lit(0).alias("left"), F.array_append(read["done"], read["now"]).alias("done"), F.array().cast(VOTERS).alias("now"))

    early = _first(
        (data.isNull() | (size < 4), "too short"),
        (_byte(data, 0) != 1, "unsupported version"),
        (~status.isin(*ADMIN_STATUS), "unknown status"),
        (hint > MAX_ADDRESS, "hint too long"),
        (base + ahead > size, "truncated fields"),
        (~fields["role"].between(1, 3), "unknown role"),
        (~fields["mode"].between(1, 2), "unknown mode"),
    )
    lists = F.when(early.isNull(), F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(lists, start, voters)
    error = F.coalesce(early, walked["error"], _first((walked["at"] != size, "trailing bytes")))
    return F.struct(
        error.alias("error"),
        _good(error, status).alias("status"),
        _good(error, part(data, 4, hint)).alias("leader_hint"),
        *[_good(error, c).alias(n) for n, c in fields.items()],
        *[_good(error, F.get(walked["done"], i)).alias(n) for i, n in enumerate(LISTS)],
    )
