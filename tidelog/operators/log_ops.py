"""Reading, checking, repairing and compacting a log of entries (log_index, term, kind, command)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import ENTRY_HEADER, MAX_BYTES, MAX_ENTRIES


def bounds(log: DataFrame) -> DataFrame:
    """One row: base_index, first_index, last_index, last_term, entries. An empty log has a last_index and term of 0."""
    return log.agg(
        (F.coalesce(F.min("log_index"), F.lit(1)) - 1).alias("base_index"),
        F.min("log_index").alias("first_index"),
        F.coalesce(F.max("log_index"), F.lit(0)).alias("last_index"),
        F.coalesce(F.max_by("term", "log_index"), F.lit(0)).alias("last_term"),
        F.count("*").alias("entries"),
    )


def entry(log: DataFrame, index: int) -> DataFrame:
    return log.filter(F.col("log_index") == index)


def suffix(log: DataFrame, first: int, base: int = 0) -> DataFrame:
    """Entries from `first`, or from behind the compacted part."""
    return log.filter(F.col("log_index") >= max(first, base + 1))


def entries_range(log: DataFrame, first: int, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, size: Column | None = None) -> DataFrame:
    """At most max_entries entries from `first` whose encoded sizes sum to at most max_bytes; the first one always.

    Indexes are contiguous, so the index filter (pushed to the scan) leaves at most max_entries rows for the window.
    """
    size = F.octet_length("command") + ENTRY_HEADER if size is None else size
    near = log.filter((F.col("log_index") >= first) & (F.col("log_index") < first + max(max_entries, 1)))
    order = W.orderBy("log_index")
    ranked = near.withColumn("__n", F.row_number().over(order)).withColumn("__sum", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.filter((F.col("__n") == 1) | ((F.col("__n") <= max_entries) & (F.col("__sum") <= max_bytes))).drop("__n", "__sum")


def term_at(log: DataFrame, indexes: DataFrame, base_index: int = 0, base_term: int = 0) -> DataFrame:
    """(log_index, term) for wanted indexes: the boundary answers its own term, compacted and future entries are unknown (null)."""
    spark = log.sparkSession
    edge = spark.range(1).select(F.lit(base_index).cast(log.schema["log_index"].dataType).alias("__i"), F.lit(base_term).cast(log.schema["term"].dataType).alias("term"))
    known = log.filter(F.col("log_index") > base_index).select(F.col("log_index").alias("__i"), "term").unionByName(edge)
    return indexes.join(known, F.col("log_index") == F.col("__i"), "left").drop("__i")


def up_to_date(candidate_term: Column, candidate_index: Column, local_term: Column, local_index: Column) -> Column:
    """Whether a candidate's log is at least as fresh: the later term, or the same term and no smaller index."""
    return (candidate_term > local_term) | ((candidate_term == local_term) & (candidate_index >= local_index))


def conflicts(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """Incoming entries that the local log lacks (local_term null) or has with another term."""
    own = local.select(F.col("log_index").alias("__i"), F.col("term").alias("local_term"))
    met = incoming.join(own, F.col("log_index") == F.col("__i"), "left").drop("__i")
    return met.filter(F.col("local_term").isNull() | (F.col("local_term") != F.col("term")))


def first_conflict(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """One row: the first index from which the local log must be replaced; null if nothing must."""
    return conflicts(incoming, local).agg(F.min("log_index").alias("first_conflict"))


def prev_matches(log: DataFrame, prev_index: int, prev_term: int, base_index: int = 0, base_term: int = 0) -> DataFrame:
    """One row: whether the entry before an incoming batch is there with that term."""
    if prev_index == base_index:
        return log.sparkSession.range(1).select(F.lit(prev_term == base_term).alias("matches"))
    return log.filter((F.col("log_index") == prev_index) & (F.col("term") == prev_term)).agg((F.count("*") > 0).alias("matches"))


def repaired(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The local log after an append: entries before the first conflict stay, from there the incoming ones follow.

    Without a conflict nothing changes, however old the incoming batch is. The first conflict is one number, so
    attaching it to both sides broadcasts a single row.
    """
    at = F.broadcast(first_conflict(incoming, local))
    keep = local.crossJoin(at).filter(F.col("first_conflict").isNull() | (F.col("log_index") < F.col("first_conflict")))
    new = incoming.crossJoin(at).filter(F.col("log_index") >= F.col("first_conflict"))
    return keep.drop("first_conflict").unionByName(new.drop("first_conflict"), allowMissingColumns=True)


def same_entries(one: DataFrame, two: DataFrame, columns: tuple[str, ...] = ("term", "kind", "command")) -> DataFrame:
    """One row: whether two ranges have the same indexes with the same entries."""
    a = one.select("log_index", F.struct(*columns).alias("a"))
    b = two.select(F.col("log_index").alias("__i"), F.struct(*columns).alias("b"))
    return a.join(b, F.col("log_index") == F.col("__i"), "full").agg((F.count_if(F.col("log_index").isNull() | F.col("__i").isNull() | ~F.col("a").eqNullSafe(F.col("b"))) == 0).alias("same"))


def compacted(log: DataFrame, index: int, base_index: int = 0) -> DataFrame:
    """The log without entries up to `index`. An older boundary changes nothing; one behind the tail fails where it is run."""
    if index <= base_index:
        return log.filter(F.col("log_index") > base_index)
    last = F.broadcast(log.agg(F.coalesce(F.max("log_index"), F.lit(base_index)).alias("__last")))
    fine = F.when(F.col("__last") >= index, F.lit(True)).otherwise(F.raise_error(F.lit(f"boundary {index} is behind the log's tail")).cast("boolean"))
    return log.crossJoin(last).filter(fine & (F.col("log_index") > index)).drop("__last")


def installed(log: DataFrame, index: int, term: int) -> DataFrame:
    """The log after a snapshot up to (index, term): its suffix stays only if the boundary entry has that term."""
    match = F.broadcast(log.filter((F.col("log_index") == index) & (F.col("term") == term)).agg((F.count("*") > 0).alias("__match")))
    return log.crossJoin(match).filter(F.col("__match") & (F.col("log_index") > index)).drop("__match")


def gaps(segments: DataFrame, base_index: int = 0) -> DataFrame:
    """Segments (start_index, entries) that no segment ends right before, with what was expected: gaps and overlaps.

    A self-join on the expected start instead of a global ordering; `expected` is the nearest end before the segment.
    """
    ends = segments.select((F.col("start_index") + F.col("entries")).alias("__end"))
    starts = ends.unionByName(segments.sparkSession.range(1).select(F.lit(base_index + 1).cast(ends.schema[0].dataType).alias("__end")))
    return segments.join(starts.distinct(), F.col("start_index") == F.col("__end"), "left_anti")


def assigned(batch: DataFrame, base: int, term: int, order: str = "arrival", block: int = 4096) -> DataFrame:
    """Proposals with contiguous indexes in queue order, however many they are.

    `order` is a dense integer: rows are ranked within blocks of it, and only the sums of blocks are accumulated in one task.
    """
    blocked = batch.withColumn("__b", F.floor(F.col(order) / block))
    ahead = blocked.groupBy(F.col("__b").alias("__c")).count().select("__c", F.coalesce(F.sum("count").over(W.orderBy("__c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    ranked = blocked.withColumn("__n", F.row_number().over(W.partitionBy("__b").orderBy(order))).join(ahead, F.col("__b").eqNullSafe(F.col("__c")))
    return ranked.withColumn("log_index", F.lit(base) + F.col("__ahead") + F.col("__n")).withColumn("term", F.lit(term)).drop("__b", "__c", "__n", "__ahead")


def encoded_bytes(log: DataFrame, column: str = "command", header: int = ENTRY_HEADER, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries and encoded bytes, by columns if wanted."""
    return log.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(F.octet_length(column) + header).alias("bytes"), F.sum(F.octet_length(column)).alias("logical_bytes"))


def waited(waiters: DataFrame, applied: DataFrame) -> DataFrame:
    """Each waiter (log_index, term) with the outcome of its entry; another term or none at all means it was lost."""
    own = applied.select(F.col("log_index").alias("__i"), F.col("term").alias("__t"), "outcome")
    met = waiters.join(own, (F.col("log_index") == F.col("__i")) & (F.col("term") == F.col("__t")), "left")
    return met.withColumn("outcome", F.coalesce("outcome", F.lit("ENTRY_LOST"))).drop("__i", "__t")


def reusable_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """New segments (start_index, content) that an old one equals and a rewrite can keep."""
    addressed = lambda d: d.select("start_index", F.sha2("content", 256).alias("digest"))
    return addressed(new).join(addressed(old), ["start_index", "digest"], "left_semi")
