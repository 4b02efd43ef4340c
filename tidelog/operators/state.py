"""From an ordered log to key-value state: last-writer-wins folds, exactly-next-sequence dedup, snapshots.

Rows are unordered, so order is always the column `log_index`. Logs have log_index, op ('PUT' or 'DELETE') and the named
key and value columns; identified logs have client_id, seq and fp (fingerprint) as well.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONFLICT, DUPLICATE, NEW, STALE


def last_writes(log: DataFrame, key: str = "k", value: str = "v", index: str = "log_index") -> DataFrame:
    """The last command for each key: one partial aggregation, so a hot key is reduced before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct("op", value, index), index).alias("__last")).select(key, F.col("__last.op").alias("op"), F.col(f"__last.`{value}`").alias(value), F.col(f"__last.`{index}`").alias(index))


def live(log: DataFrame, key: str = "k", value: str = "v", index: str = "log_index") -> DataFrame:
    """The state after all commands of `log`: the keys whose last command is a PUT. A deleted key is absent, an empty value isn't."""
    return last_writes(log, key, value, index).filter("op = 'PUT'").select(key, value, index)


def committed(log: DataFrame, last_applied: int | Column = 0, commit_index: int | Column | None = None, index: str = "log_index") -> DataFrame:
    """Rows above last_applied and up to commit_index."""
    out = log.filter(F.col(index) > last_applied)
    return out if commit_index is None else out.filter(F.col(index) <= commit_index)


def applications(log: DataFrame) -> DataFrame:
    """Entries that reach the fold: neither no-ops nor configurations."""
    return log.filter(F.col("kind") == 0)


def state_at(log: DataFrame, read_index: int, key: str = "k", value: str = "v", index: str = "log_index") -> DataFrame:
    """The state that a read at `read_index` sees."""
    return live(log.filter(F.col(index) <= read_index), key, value, index)


def get(state: DataFrame, requests: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Point reads: every request row with the value and OK or NOT_FOUND."""
    right = state.select(F.col(key).alias("__k"), F.col(value), F.lit(True).alias("__there"))
    out = requests.join(right, F.col(key) == F.col("__k"), "left")
    return out.withColumn("status", F.when(F.col("__there"), "OK").otherwise("NOT_FOUND")).drop("__k", "__there")


def get_at(log: DataFrame, requests: DataFrame, read_index: int, key: str = "k", value: str = "v") -> DataFrame:
    """Reads at an index. The requested keys filter the log before the fold."""
    wanted = log.join(requests.select(key).distinct(), key, "left_semi")
    return get(state_at(wanted, read_index, key, value), requests, key, value)


def outcome(seq: Column, fp: Column, last_seq: Column, last_fp: Column) -> Column:
    """What a request is, given its client's record (null: none): only the next sequence number is new."""
    last = F.coalesce(last_seq, F.lit(0))
    return F.when(seq == last, F.when(fp == last_fp, DUPLICATE).otherwise(CONFLICT)).when(seq == last + 1, NEW).otherwise(STALE)


#: The `op` of a row that is a client's record from a snapshot: its sequence number and fingerprint are taken over.
RECORD = "RECORD"


def _fold(clients: list, seqs: list, prints: list, last: tuple, ops: list | None = None) -> tuple[list[str], tuple]:
    """Outcomes of rows in order, from the record (client, last sequence, fingerprint) before them to the one after them."""
    client, seq, print_ = last
    out = []
    for c, s, f, o in zip(clients, seqs, prints, ops or itertools.repeat(None, len(seqs)), strict=True):
        if c != client:
            client, seq, print_ = c, 0, None
        if o == RECORD:
            seq, print_ = s, f
            out.append(RECORD)
        elif s == seq:
            out.append(DUPLICATE if f == print_ else CONFLICT)
        elif s == seq + 1:
            seq, print_ = s, f
            out.append(NEW)
        else:
            out.append(STALE)
    return out, (client, seq, print_)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = (None, 0, None)
    for b in batches:
        ops = b.column("op").to_pylist() if "op" in b.schema.names else None
        out, last = _fold(*(b.column(c).to_pylist() for c in ("client_id", "seq", "fp")), last, ops)
        yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "outcome"])


def identified(client: Column) -> Column:
    """Whether a client id, as bytes or a number, names a client: null and the all-zero bytes don't."""
    return client.isNotNull() & ~F.coalesce(client.cast("binary").eqNullSafe(F.lit(b"\0" * 16)), F.lit(False))


def classify(log: DataFrame, index: str = "log_index") -> DataFrame:
    """Add `outcome` to every row of an identified log.

    Rows of an unidentified client (see `identified`) are always NEW and aren't shuffled. Whether a sequence number is
    accepted depends on where its predecessor was, so a client's rows are folded in order, as a stream over its sorted
    rows: linear, with one record in memory however many rows a client has. Columns pass through as Arrow buffers. Rows whose
    `op` is RECORD, if there are any, are where a client's rows start from, and stay as such.
    """
    known = identified(F.col("client_id")) if dict(log.dtypes)["client_id"] == "binary" else F.col("client_id").isNotNull()
    anonymous = log.filter(~known).withColumn("outcome", F.lit(NEW))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema) + ", outcome string"
    named = log.filter(known).repartition("client_id").sortWithinPartitions("client_id", index)
    return named.mapInArrow(_streamed, schema).unionByName(anonymous)


def identified_state(log: DataFrame, key: str = "k", value: str = "v", index: str = "log_index") -> DataFrame:
    """The state that only NEW commands make: a shuffle by client, then one by key."""
    return live(classify(log, index).filter(F.col("outcome") == NEW), key, value, index)


def client_records(log: DataFrame, index: str = "log_index") -> DataFrame:
    """(client_id, last_seq, last_fingerprint, last_result) after the log: the last NEW request of each client."""
    new = classify(log.filter("client_id is not null"), index).filter(F.col("outcome") == NEW)
    return new.groupBy("client_id").agg(F.max("seq").alias("last_seq"), F.max_by("fp", "seq").alias("last_fingerprint")).withColumn("last_result", F.lit(1).cast("tinyint"))


def lookup(requests: DataFrame, records: DataFrame) -> DataFrame:
    """What each request would be, without applying any."""
    known = records.select(F.col("client_id").alias("__c"), "last_seq", "last_fingerprint")
    out = requests.join(known, F.col("client_id") == F.col("__c"), "left")
    return out.withColumn("outcome", outcome(F.col("seq"), F.col("fp"), F.col("last_seq"), F.col("last_fingerprint"))).drop("__c", "last_seq", "last_fingerprint")


def single_flight(requests: DataFrame) -> DataFrame:
    """(client_id, seq, waiters, outcome) of requests in flight together: one is proposed, equal ones wait, others conflict."""
    return requests.groupBy("client_id", "seq").agg(
        F.count("*").alias("waiters"),
        F.when(F.min("fp") == F.max("fp"), "SHARED").otherwise(CONFLICT).alias("outcome"),
    )


def halted(log: DataFrame, bad: DataFrame, index: str = "log_index") -> DataFrame:
    """The rows before the first failed one: a failure stops all later application."""
    first = bad.agg(F.min(index).alias("__stop"))
    return log.join(F.broadcast(first), F.lit(True), "left").filter(F.col("__stop").isNull() | (F.col(index) < F.col("__stop"))).drop("__stop")


def snapshot(log: DataFrame, last_applied: int, key: str = "k", value: str = "v", index: str = "log_index") -> DataFrame:
    """The state at last_applied, as rows of a log that a suffix may follow."""
    return state_at(log, last_applied, key, value, index).withColumn("op", F.lit("PUT"))


def restored(snap: DataFrame, suffix: DataFrame, boundary: int, commit_index: int | None = None, key: str = "k", value: str = "v", index: str = "log_index") -> DataFrame:
    """State from a snapshot and the committed rows after its boundary."""
    cols = [key, "op", value, index]
    return live(snap.select(cols).unionByName(committed(suffix, boundary, commit_index, index).select(cols)), key, value, index)


def unidentified(op: str, key, value=None) -> dict:
    """A command without identity, as a row."""
    return {"op": op, "client_id": None, "seq": None, "k": key, "v": value}


def ordered_snapshot(state: DataFrame, key: str = "k") -> DataFrame:
    """Keys in byte order, as the snapshot format has them."""
    return state.orderBy(key)


def close_batches(sizes: np.ndarray, out: np.ndarray, was: tuple[int, int, int], most_entries: int, most_bytes: int) -> tuple[int, int, int]:
    """Write the batch number of each proposal to `out`, from (batch, entries, bytes) of the open batch to those after them.

    The end of a batch is found in the running totals, so the work is a step for each batch, not for each proposal.
    """
    batch, entries, total = was
    to, at = np.concatenate(([0], np.cumsum(sizes))), 0
    while at < len(sizes):
        fits = int(np.searchsorted(to, to[at] + most_bytes - total, side="right")) - 1
        end = min(fits, at + most_entries - entries, len(sizes))
        if end <= at and entries:
            batch, entries, total = batch + 1, 0, 0
            continue
        end = max(end, at + 1)  # one over the limit goes alone
        out[at:end] = batch
        entries, total, at = entries + end - at, total + int(to[end] - to[at]), end
    return batch, entries, total


def batch_ids(proposals: DataFrame, most_entries: int = 256, most_bytes: int = 4 << 20, order: str = "arrival", size: str = "bytes", group: str = "node_id") -> DataFrame:
    """Add `batch`, numbered from 0 in each group: a batch closes at most_entries or before most_bytes would be passed.

    A proposal over the byte limit is a batch of its own. Batches depend on all earlier ones, so a group's rows (a node's
    own queue) are folded in order as a sorted stream.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proposals.schema) + ", batch bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_batch = object(), (0, 0, 0)
        for b in batches:
            groups, sizes = b.column(group).to_pylist(), b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]]
            out = np.zeros(len(groups), np.int64)
            for at, end in zip(starts, [*starts[1:], len(groups)], strict=True):
                open_batch = open_batch if groups[at] == now else (0, 0, 0)
                now = groups[at]
                open_batch = close_batches(sizes[at:end], out[at:end], open_batch, most_entries, most_bytes)
            yield pa.record_batch([*b.columns, pa.array(out)], names=[*b.schema.names, "batch"])

    return proposals.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def classify_group(rows: pd.DataFrame, last_seq: int = 0, last_fp: str | None = None) -> tuple[list[str], int, str | None]:
    """The fold over one client's rows (in order), with the client's record before and after."""
    one = [0] * len(rows)
    out, (_, seq, print_) = _fold(one, rows["seq"].tolist(), rows["fp"].tolist(), (0, last_seq, last_fp))
    return out, int(seq), print_
