"""The apply loop as Structured Streaming: keyed dedup, keyed state, and the batch-by-batch form.

Order is the log's, not event time: late or early sequence numbers are answered, never buffered, so no watermark is
used. Exactly-once comes from the checkpoint; a restart continues from its state and offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import state as st
from ..schemas import NEW

OUTCOMES = "log_index bigint, client_id bigint, seq bigint, k string, op string, v bigint, fp string, outcome string"
RECORD = "last_seq bigint, last_fp string, last_index bigint"


def read_log(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int | None = None) -> DataFrame:
    """A log folder as a stream of its new files, so many a micro-batch if wanted."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _apply(key: tuple, parts: Iterator[pd.DataFrame], record: GroupState) -> Iterator[pd.DataFrame]:
    last_seq, last_fp, last_index = record.get if record.exists else (0, None, 0)
    # A micro-batch has no order of its own; a client's rows of one batch are what this holds in memory.
    rows = pd.concat(list(parts)).sort_values("log_index", kind="stable")
    rows = rows[rows["log_index"] > last_index]  # each index is applied once
    if len(rows):
        out, last_seq, last_fp = st.classify_group(rows, last_seq, last_fp)
        rows["outcome"] = out
        record.update((last_seq, last_fp, int(rows["log_index"].iloc[-1])))
        yield rows


def classified_stream(log: DataFrame) -> DataFrame:
    """Every request of a streamed log with its outcome; state is each client's last accepted request."""
    return log.groupBy("client_id").applyInPandasWithState(_apply, OUTCOMES, RECORD, "append", GroupStateTimeout.NoTimeout)


def state_stream(classified: DataFrame) -> DataFrame:
    """The last command for each key so far (update mode): keyed aggregation state of one row a key."""
    last = F.max_by(F.struct("op", "v", "log_index"), "log_index").alias("last")
    return classified.groupBy("k").agg(last).select("k", "last.op", "last.v", "last.log_index")


def apply_batches(log: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `handle` on each micro-batch in turn (index order is its business), once, and stop when the log is drained."""
    return log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_table_updater(root: str) -> Callable[[DataFrame, int], None]:
    """A handler that folds NEW commands into a published state table; repeated batches change nothing, as indexes decide."""
    from ..sources import sinks

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter(F.col("outcome") == NEW).select("k", "op", "v", "log_index")
        if sinks.has_table(spark, root):  # the first batch finds none
            fresh = fresh.unionByName(sinks.current(spark, root).select("k", "op", "v", "log_index"))
        sinks.publish(st.last_writes(fresh), root)

    return handle
