"""A load generator's operations as rows, with what a run of them counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import client_outcome
from ..functions.text import load_key, session_client_id

WORKERS, PUT_OF_TEN = 16, 7


def operations(spark: SparkSession, per_worker: int, workers: int = WORKERS) -> DataFrame:
    """(worker, operation, kind, key, value, client_id, seq): of ten operations seven write; the others read the last key written."""
    rows = spark.range(workers * per_worker).select((F.col("id") % workers).alias("worker"), F.floor(F.col("id") / workers).alias("operation"))
    return described(rows)


def described(rows: DataFrame) -> DataFrame:
    """What each (worker, operation) does."""
    at = F.col("operation") % 10
    puts = at < PUT_OF_TEN
    last = F.when(puts, F.col("operation")).otherwise(F.col("operation") - at + (PUT_OF_TEN - 1))
    key = load_key(F.col("worker"), last)
    # The sequence number of a write is the number of writes up to it, which is known without counting.
    seq = F.floor(F.col("operation") / 10) * PUT_OF_TEN + at + 1
    return rows.select("worker", "operation", F.when(puts, "PUT").otherwise("GET").alias("kind"), key.alias("key"), F.when(puts, F.concat(F.lit("value-"), key)).alias("value"), F.when(puts, session_client_id(F.col("worker"), F.lit(0))).alias("client_id"), F.when(puts, seq).alias("seq"))


def outcomes(results: DataFrame, by: tuple[str, ...] = ("phase",)) -> DataFrame:
    """(by..., acknowledged, ambiguous_write_outcomes, transient_read_failures, unexpected): rows have kind and error (null: fine)."""
    kind = client_outcome(F.col("error"))
    put = F.col("kind") == "PUT"
    return results.groupBy(*by).agg(
        F.count_if(put & (kind == "ok")).alias("acknowledged"),
        F.count_if(put & kind.isin("ambiguous", "transport")).alias("ambiguous_write_outcomes"),
        F.count_if(~put & kind.isin("ambiguous", "expected_read", "transport")).alias("transient_read_failures"),
        F.count_if(kind == "unexpected").alias("unexpected"),
    )


def handled(requests: DataFrame, handle: Callable[[bytes], bytes], column: str = "payload") -> DataFrame:
    """Requests with `response`, what `handle` gives for each payload; in Arrow batches, one call a row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", response binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if p is None else handle(p) for p in b.column(column).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "response"])

    return requests.mapInArrow(run, schema)


def observed(rows: DataFrame, name: str, **figures: Column):
    """(rows, observation): figures that are computed while the rows are written, without another pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in figures.items()]), seen
