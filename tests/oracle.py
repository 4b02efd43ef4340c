"""Holding a query's rows against DuckDB's for its SQL."""

import glob
import math
import os

import duckdb


def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return str(int(f)) if math.isfinite(f) and f == int(f) else f"{f:.9g}" if not isinstance(v, str) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(v if isinstance(v := r[i], str) else plain(v) for i in order) for r in values)


def differences(query, sql, spark, sf_dir, connection):
    """None if both give the same columns and rows, else a short account."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = connection.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    only = [r for r in got[1] if r not in set(want[1])][:3]
    miss = [r for r in want[1] if r not in set(got[1])][:3]
    return f"{len(got[1])} and {len(want[1])} rows; only here {only}; only there {miss}"
