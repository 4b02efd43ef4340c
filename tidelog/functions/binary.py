"""Binary layouts as column expressions: big-endian numbers, commands, requests, responses, fingerprints.

Every decoder gives a struct whose `error` is null for a valid payload; an invalid one has an error and null fields,
so bad rows can be filtered, quarantined or raised (`checked`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DELETE, MAX_HINT, MAX_KEY, MAX_VALUE, PUT, REQUEST_DELETE, REQUEST_GET, REQUEST_PUT

ZERO_ID = b"\0" * 16


def be(number: Column, width: int) -> Column:
    """A non-negative number in `width` big-endian bytes. Decimals over 2^63 - 1 keep their value."""
    return F.unhex(F.lpad(F.conv(number.cast("string"), 10, 16), 2 * width, "0"))


def unsigned(data: Column) -> Column:
    """Big-endian bytes (up to eight) as decimal(20,0)."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def part(data: Column, start: Column | int, length: Column | int) -> Column:
    """Bytes from a zero-based start."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(data, (start + 1).cast("int"), length.cast("int"))


def _byte(data: Column, at: int) -> Column:
    return unsigned(part(data, at, 1)).cast("int")


def _or_empty(data: Column) -> Column:
    return F.coalesce(data, F.lit(b""))


def fingerprint(op: Column, key: Column, value: Column) -> Column:
    """SHA-256 (hex) of type, key length, key, value length, value: what a request asks for, whoever asks."""
    key, value = _or_empty(key), _or_empty(value)
    return F.sha2(F.concat(be(op, 1), be(F.octet_length(key), 4), key, be(F.octet_length(value), 4), value), 256)


def text_fingerprint(op: Column, key: Column, value: Column) -> Column:
    """The same over text, for logs whose keys and values are no bytes: op|key|value with an empty string for null."""
    return F.sha2(F.concat_ws("|", op, F.coalesce(key, F.lit("")), F.coalesce(value.cast("string"), F.lit(""))), 256)


def encode_command(op: Column, key: Column, value: Column, client_id: Column | None = None, seq: Column | None = None) -> Column:
    """Version 1 without an identity, version 2 with one."""
    key, value = _or_empty(key), _or_empty(value)
    tail = F.concat(be(F.octet_length(key), 4), be(F.octet_length(value), 4), key, value)
    plain = F.concat(F.lit(b"\x01"), be(op, 1), tail)
    if client_id is None:
        return plain
    named = F.concat(F.lit(b"\x02"), be(op, 1), client_id, be(seq, 8), tail)
    return F.when(client_id.isNull() | (client_id == F.lit(ZERO_ID)), plain).otherwise(named)


def _first(*tests: tuple[Column, str]) -> Column:
    out = None
    for test, said in tests:
        out = F.when(test, said) if out is None else out.when(test, said)
    return out


def decode_command(data: Column) -> Column:
    """struct(error, op, client_id, seq, key, value); unidentified commands have null client_id and seq."""
    size = F.octet_length(data)
    version, op = _byte(data, 0), _byte(data, 1)
    named = version == 2
    head = F.when(named, 34).otherwise(10)
    lengths = F.when(named, 26).otherwise(2)
    klen, vlen = unsigned(part(data, lengths, 4)), unsigned(part(data, lengths + 4, 4))
    client, seq = part(data, 2, 16), unsigned(part(data, 18, 8))
    error = _first(
        (data.isNull() | (size < 10), "too short"),
        (~version.isin(1, 2), "unsupported version"),
        (named & (size < 34), "too short"),
        (~op.isin(PUT, DELETE), "unknown operation"),
        ((klen > MAX_KEY) | (vlen > MAX_VALUE), "length out of bounds"),
        ((op == DELETE) & (vlen != 0), "DELETE with a value"),
        (named & ((client == F.lit(ZERO_ID)) | (seq == 0)), "invalid identity"),
        (size != head + klen + vlen, "length mismatch"),
    )
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(
        error.alias("error"),
        good(op).cast("tinyint").alias("op"),
        good(F.when(named, client)).alias("client_id"),
        good(F.when(named, seq)).alias("seq"),
        good(part(data, head, klen)).alias("key"),
        good(part(data, head + klen, vlen)).alias("value"),
    )


def encode_request(operation: Column, client_id: Column, seq: Column, key: Column, value: Column) -> Column:
    key, value = _or_empty(key), _or_empty(value)
    return F.concat(F.lit(b"\x01"), be(operation, 1), F.coalesce(client_id, F.lit(ZERO_ID)), be(F.coalesce(seq, F.lit(0)), 8), be(F.octet_length(key), 4), be(F.octet_length(value), 4), key, value)


def request_errors(operation: Column, client_id: Column, seq: Column, value: Column) -> Column:
    """What is wrong with a request's identity, or null: writes need one, reads carry none, only PUT has a value."""
    zero = client_id.isNull() | (client_id == F.lit(ZERO_ID))
    none = seq.isNull() | (seq == 0)
    writes = operation.isin(REQUEST_PUT, REQUEST_DELETE)
    return _first(
        (operation.isNull() | ~operation.isin(REQUEST_PUT, REQUEST_GET, REQUEST_DELETE), "unknown operation"),
        (writes & zero, "client id required"),
        (writes & none, "sequence required"),
        ((operation == REQUEST_GET) & ~(zero & none), "identity on a read"),
        (operation.isin(REQUEST_GET, REQUEST_DELETE) & (F.octet_length(_or_empty(value)) > 0), "value not allowed"),
    )


def decode_request(data: Column) -> Column:
    """struct(error, operation, client_id, seq, key, value)."""
    size = F.octet_length(data)
    version, op = _byte(data, 0), _byte(data, 1)
    client, seq = part(data, 2, 16), unsigned(part(data, 18, 8))
    klen, vlen = unsigned(part(data, 26, 4)), unsigned(part(data, 30, 4))
    key, value = part(data, 34, klen), part(data, F.lit(34) + klen, vlen)
    error = F.coalesce(
        _first((data.isNull() | (size < 34), "too short"), (version != 1, "unsupported version")),
        request_errors(op, client, seq, F.lit(b"")),
        _first(
            ((klen > MAX_KEY) | (vlen > MAX_VALUE), "length out of bounds"),
            (op.isin(REQUEST_GET, REQUEST_DELETE) & (vlen != 0), "value not allowed"),
            (size != 34 + klen + vlen, "length mismatch"),
        ),
    )
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(error.alias("error"), good(op).cast("tinyint").alias("operation"), good(client).alias("client_id"), good(seq).alias("seq"), good(key).alias("key"), good(value).alias("value"))


def encode_response(status: Column, hint: Column, value: Column) -> Column:
    hint, value = _or_empty(hint), _or_empty(value)
    return F.concat(F.lit(b"\x01"), be(status, 1), be(F.octet_length(hint), 2), be(F.octet_length(value), 4), hint, value)


def decode_response(data: Column) -> Column:
    """struct(error, status, leader_hint, value)."""
    size = F.octet_length(data)
    version, status = _byte(data, 0), _byte(data, 1)
    hlen, vlen = unsigned(part(data, 2, 2)), unsigned(part(data, 4, 4))
    error = _first(
        (data.isNull() | (size < 8), "too short"),
        (version != 1, "unsupported version"),
        (~status.between(1, 9), "unknown status"),
        ((hlen > MAX_HINT) | (vlen > MAX_VALUE), "length out of bounds"),
        (size != 8 + hlen + vlen, "length mismatch"),
    )
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(error.alias("error"), good(status).cast("tinyint").alias("status"), good(part(data, 8, hlen)).alias("leader_hint"), good(part(data, F.lit(8) + hlen, vlen)).alias("value"))


def checked(decoded: Column) -> Column:
    """The struct itself; a row with an error fails the query."""
    return F.when(decoded["error"].isNull(), decoded).otherwise(F.raise_error(decoded["error"]))


def client_id_hex(client_id: Column) -> Column:
    return F.lower(F.hex(client_id))


def new_client_id() -> Column:
    """A random identity (16 bytes)."""
    return F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))
