"""All queries over the log, protocol, operations and binary planes, and their SQL."""

from __future__ import annotations

from . import binary_plane, operations, oracles, protocol, workloads


def queries() -> dict:
    return workloads.queries() | protocol.QUERIES | operations.QUERIES | binary_plane.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | protocol.SQL | operations.SQL | binary_plane.SQL
