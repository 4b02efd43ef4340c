"""Deriving a command log from the `events` table.

`events` gives a clean log (every request new) and an anomaly log with copies, changed retries, skipped and gapped
sequence numbers, so that every outcome of the dedup rule occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.binary import text_fingerprint


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _commands(rows: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    return rows.select(
        "event_id",
        F.col("user_id").alias("client_id"),
        F.get_json_object("props", "$.k").alias("k"),
        op.alias("op"),
        F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("bigint")).alias("v"),
    )


def clean_log(rows: DataFrame) -> DataFrame:
    """(log_index, k, op, v): no identity needed, so no shuffle."""
    return _commands(rows).select((F.col("event_id") + 1).alias("log_index"), "client_id", "k", "op", "v")


def identified(rows: DataFrame) -> DataFrame:
    """Commands with each client's sequence number."""
    return _commands(rows).withColumn("seq", F.row_number().over(W.partitionBy("client_id").orderBy("event_id")).cast("bigint"))


def anomaly_log(rows: DataFrame) -> DataFrame:
    """(log_index, client_id, seq, k, op, v, fp), with retries, conflicts and gaps.

    Log indexes are the ranks of positions. A position is three times an event's number plus 0, 1 or 2, so ranks come
    from sums over blocks of positions and ranks within blocks, not from one global sort in a single task.
    """
    own = identified(rows).filter(~((F.col("client_id") % 50 == 7) & (F.col("seq") == 20)))
    e = F.col("event_id")
    variants = F.array_compact(
        F.array(
            F.struct((e * 3).alias("pos"), "seq", "v"),
            F.when(e % 10 == 0, F.struct((e * 3 + 1).alias("pos"), F.col("seq"), F.col("v"))),
            F.when((e % 10 == 5) & (F.col("op") == "PUT"), F.struct((e * 3 + 1).alias("pos"), F.col("seq"), (F.col("v") + 1).alias("v"))),
            F.when(e % 10 == 7, F.struct((e * 3 + 2).alias("pos"), (F.col("seq") + 5).alias("seq"), F.col("v"))),
        )
    )
    every = own.select("client_id", "k", "op", F.explode(variants).alias("x")).select("client_id", "k", "op", "x.pos", "x.seq", "x.v")
    ranked = with_rank(every, "pos", 4096, "log_index")
    return ranked.select("log_index", "client_id", "seq", "k", "op", "v", text_fingerprint(F.col("op"), F.col("k"), F.col("v")).alias("fp"))


def with_rank(df: DataFrame, order: str, block: int, name: str) -> DataFrame:
    """Add the 1-based rank by a dense non-negative bigint column: block totals are accumulated, rows are ranked in their block."""
    blocked = df.withColumn("__b", F.floor(F.col(order) / block))
    ahead = blocked.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(W.partitionBy("__b").orderBy(order))
    return blocked.withColumn("__n", inside).join(ahead, "__b").withColumn(name, F.col("__ahead") + F.col("__n")).drop("__b", "__n", "__ahead")
