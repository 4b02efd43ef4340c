"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target share of all words (waterfilling under a repeat limit). Its weight over training time t in
[0, 1] is linear, w(t) = 1 + tilt * (2t - 1); the integral of that schedule is the source's cumulative word demand
D(t) = target * (t + tilt * (t * t - t)), and a document that starts at cumulative word c of its source is trained at
the position t with D(t) = c. Documents are then range-sorted by position.

The running word count of a source is never taken in one task: documents are dealt to 4096 hash buckets of each
source, sizes are summed for each bucket, and only those sums are accumulated over a source. A source with a third of all
rows is spread over all buckets.

Defined results: null and empty texts have size 0 and aren't taken; a null source is a source, sorted last; repeated rows
and null ids are rows of their own; the order within a source is by hash of the id, then id, then size, so reruns agree;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, whole

#: Hash buckets of a source are the first hexadecimal digits of the hash, so that buckets follow the order by hash.
BUCKET_DIGITS = 3
CYCLE = (1, 2, 3)
MOST_REPEATS = 3
#: Tilts of the schedules, repeating like the weights: early, even and late sources.
TILTS = (-0.5, 0.0, 0.5)


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a whole text; 0 for null."""
    return F.regexp_count(whole(F.col(text)), F.lit(WORD)).cast("bigint")


def targets(by_source: DataFrame, weights: Sequence[int] = CYCLE, tilts: Sequence[float] = TILTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, tilt, target) from (source, source_size), one row for each source.

    Waterfilling in closed form: sources in the order in which they would reach their limit are capped as long as an
    even share by weight of what is left would exceed their limit. The windows run over sources, not documents.
    """
    every = W.partitionBy()
    ranked = by_source.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("i") % len(values) + 1).cast("int"))
    own = ranked.select("source", "source_size", "i", cycle(weights).alias("weight"), cycle(tilts).alias("tilt"), (most * F.col("source_size")).alias("cap"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), "i")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = own.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "i", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest * F.col("weight"))
    return filled.select("source", "source_size", "weight", "tilt", target.cast("double").alias("target"))


def _inverse(share: Column, tilt: Column) -> Column:
    """t in [0, 1] with t + tilt * (t * t - t) = share."""
    b = 1 - tilt
    root = F.sqrt(F.greatest(b * b + 4 * tilt * share, F.lit(0.0)))
    return F.when((tilt == 0) | (share <= 0), share).otherwise(F.least((2 * share) / F.nullif(b + root, F.lit(0.0)), F.lit(1.0)))


def _placed(docs: DataFrame, id_col: str, text: str, source: str, most: int) -> DataFrame:
    """(id, source, size, source_size, target, tilt, start, turns, left): a document's first word in its source, its whole passes, and the words that the last, cut pass of its source has."""
    measured = cut(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), sizes(docs, text).alias("size")))
    dealt = measured.withColumn("h", F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256)).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = cut(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), most=most)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = offsets.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target", "tilt")
    within = W.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = placed.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("offset") + F.col("ahead")
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(0)
    left = F.floor(F.col("target") - turns * F.col("source_size") + 0.5)
    return rows.select("id", "source", "size", "source_size", "target", "tilt", start.alias("start"), turns.alias("turns"), left.alias("left"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_REPEATS) -> DataFrame:
    """(id, source, size, source_size, target, taken, position) for every row, ordered by position.

    `taken` counts a document's words in the mix, repeats included; the first copy has the position, `passes` has those of
    all. Documents that aren't taken have none.
    """
    rows = _placed(docs, id_col, text, source, most)
    # The document at which the target is reached is cut there, so a source's words meet its target to a word.
    taken = F.col("turns") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start")))
    share = F.least(F.col("start") / F.nullif("target", F.lit(0.0)), F.lit(1.0))
    out = rows.select("id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), share.alias("share"), "tilt")
    out = out.select("id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, _inverse(F.col("share"), F.col("tilt"))).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "id")


def passes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_REPEATS) -> DataFrame:
    """(id, source, pass, taken, position) for every time that a document is taken, ordered by position: pass n begins n times the source's size later."""
    rows = _placed(docs, id_col, text, source, most).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns").cast("bigint"))))
    words = F.when(F.col("pass") < F.col("turns"), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start"))))
    share = F.least((F.col("start") + F.col("pass") * F.col("source_size")) / F.nullif("target", F.lit(0.0)), F.lit(1.0))
    out = rows.select("id", "source", "pass", words.cast("bigint").alias("taken"), _inverse(share, F.col("tilt")).alias("position"))
    return out.filter("taken > 0").orderBy("position", "id", "pass")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table with doc_id, text and source; `position` follows."""
    out = mixed(docs.select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
