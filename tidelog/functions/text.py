"""Small text forms: addresses, keys, names of generations, identities, numbers for people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import be

#: Delays that clients and nodes use, in milliseconds.
ELECTION_MS, HEARTBEAT_MS, RECENT_CONTACT_MS = (150, 300), 50, 150


def peer(text: Column) -> Column:
    """struct(error, node_id, addr) of `ID=ADDRESS`: cut at the first `=`; the id is a positive number."""
    cut = F.locate("=", text)
    left, addr = F.substr(text, F.lit(1), cut - 1), F.substr(text, cut + 1)
    number = F.when(left.rlike(r"^[0-9]{1,20}$"), left.cast("decimal(20,0)"))
    error = F.when(text.isNull() | (cut == 0), "want ID=ADDRESS").when(number.isNull() | (number == 0), "the id must be a positive number").when(addr == "", "the address is empty")
    return F.struct(error.alias("error"), F.when(error.isNull(), number).alias("node_id"), F.when(error.isNull(), addr).alias("addr"))


def items(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def load_key(worker: Column, operation: Column) -> Column:
    """The key that a load generator's worker writes in an operation."""
    return F.format_string("load-client-%02d-write-%05d", worker.cast("bigint"), operation.cast("bigint"))


def session_client_id(worker: Column, session: Column) -> Column:
    """The identity (16 bytes) of a load generator's session, the same in every run."""
    low = be(F.pmod(session, F.lit(256)), 1)
    high = be(F.pmod(F.floor(session / 256), F.lit(256)), 1)
    return F.concat(F.lit(b"\x25"), be(F.pmod(worker, F.lit(256)), 1), low, high, F.lit(b"\0" * 12))


def generation_number(name: Column) -> Column:
    """The number in a generation's name; null for another name."""
    digits = F.regexp_extract(name, r"^g([0-9]{20})$", 1)
    return F.when(digits != "", digits.cast("decimal(20,0)"))


def labelled(label: str, value: Column) -> Column:
    """`label="value"`, with backslashes, quotes and line ends escaped."""
    safe = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(f'{label}="'), safe, F.lit('"'))


def is_commit_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{40}$"), F.lit(False))


def grouped(number: Column) -> Column:
    """A number with thousands separated by commas."""
    return F.format_number(number, 0)


def clock(seconds: Column) -> Column:
    """Seconds with three places, zero-padded to six characters."""
    text = F.format_string("%.3f", seconds.cast("double"))
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


class BadArguments(ValueError):
    """Arguments that a node or a client can't be started with."""


_LEVELS = ("debug", "info", "warn", "error")


def node_arguments(node_id: int, listen: str, data: str, peers: list[str], log_level: str = "info") -> dict[int, str]:
    """The peers of a node's arguments, which must all be there and agree: no peer, id or address twice, and not itself."""
    for name, value in (("id", node_id > 0), ("listen", listen), ("data", data)):
        if not value:
            raise BadArguments(f"{name} is required")
    if log_level not in _LEVELS:
        raise BadArguments(f"log level {log_level}")
    out: dict[int, str] = {}
    for text in peers:
        m = re.fullmatch(r"([0-9]+)=(.+)", text, re.S)
        if not m or int(m[1]) == 0:
            raise BadArguments(f"peer {text}: want ID=ADDRESS")
        if int(m[1]) in out or m[2] in out.values():
            raise BadArguments(f"peer {text} repeats an id or an address")
        out[int(m[1])] = m[2]
    if node_id in out:
        raise BadArguments("a node is no peer of itself")
    return out


def client_arguments(addresses: list[str], timeout: float) -> list[str]:
    if not addresses:
        raise BadArguments("an address is required")
    if timeout <= 0:
        raise BadArguments(f"timeout of {timeout}")
    return addresses
