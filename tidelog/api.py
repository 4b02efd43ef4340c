"""A small session over a published log: put, get, delete, status, snapshot, as rows and tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.binary import text_fingerprint
from .operators import log_ops, state
from .schemas import NEW
from .sources import sinks

COMMANDS = "log_index bigint, client_id bigint, seq bigint, k string, op string, v string"


@dataclass
class Store:
    """Commands appended under `root`/log by one writer; reads fold them, from the last snapshot on if there is one."""

    spark: SparkSession
    root: str
    _sequences: dict[int, int] = field(default_factory=dict)

    def log(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(COMMANDS).parquet(f"{self.root}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], COMMANDS)
        return rows.withColumn("fp", text_fingerprint(F.col("op"), F.col("k"), F.col("v")))

    def _snapshot(self) -> tuple[DataFrame | None, int]:
        """(rows of the last snapshot, its boundary); none, and 0, without one."""
        if not sinks.has_table(self.spark, f"{self.root}/snapshot"):
            return None, 0
        rows = sinks.current(self.spark, f"{self.root}/snapshot")
        return rows, int(rows.agg(F.max("boundary")).first()[0] or 0)

    def _classified(self, at: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(classified rows behind the last snapshot that `at` allows, that snapshot)."""
        snap, boundary = self._snapshot()
        if snap is None or (at is not None and at < boundary):
            snap, boundary = None, 0
        rows = self.log().filter(F.col("log_index") > boundary)
        rows = rows if at is None else rows.filter(F.col("log_index") <= at)
        if snap is not None:
            records = snap.filter("part = 'client'").select("log_index", "client_id", "seq", F.lit(None).cast("string").alias("k"), F.lit(state.RECORD).alias("op"), F.lit(None).cast("string").alias("v"), "fp")
            rows = rows.unionByName(records)
        return state.classify(rows), snap

    def last_index(self) -> int:
        here = int(log_ops.bounds(self.log().withColumn("term", F.lit(1))).first()["last_index"])
        return max(here, self._snapshot()[1])

    def _append(self, op: str, key: str, value: str | None, client: int | None, seq: int | None) -> str:
        if client is not None and seq is None:
            seq = self._sequences.get(client, 0) + 1
        index = self.last_index() + 1
        row = self.spark.createDataFrame([(index, client, seq, key, op, value)], COMMANDS)
        sinks.append(row.coalesce(1), f"{self.root}/log")
        outcome = self._classified()[0].filter(F.col("log_index") == index).first()["outcome"]
        if client is not None and outcome == NEW:  # the number advances on success alone
            self._sequences[client] = seq
        return outcome

    def put(self, key: str, value: str, client: int | None = None, seq: int | None = None) -> str:
        return self._append("PUT", key, value, client, seq)

    def delete(self, key: str, client: int | None = None, seq: int | None = None) -> str:
        """Deleting a missing key is fine and changes nothing."""
        return self._append("DELETE", key, None, client, seq)

    def state(self, at: int | None = None) -> DataFrame:
        """(k, v, log_index) now or at an index; one before the last snapshot needs the log that the snapshot has replaced."""
        rows, snap = self._classified(at)
        new = rows.filter(F.col("outcome") == NEW).select("k", "op", "v", "log_index")
        if snap is not None:
            new = new.unionByName(snap.filter("part = 'kv'").select("k", F.lit("PUT").alias("op"), "v", "log_index"))
        return state.live(new)

    def get(self, key: str, at: int | None = None) -> tuple[str, str | None]:
        """(status, value) of a read, now or at an index."""
        found = self.state(at).filter(F.col("k") == key).first()
        return ("OK", found["v"]) if found else ("NOT_FOUND", None)

    def status(self) -> dict:
        rows = log_ops.bounds(self.log().withColumn("term", F.lit(1))).first().asDict()
        return rows | {"live_keys": self.state().count()}

    def snapshot(self) -> str:
        """Publish state and client records together as a new generation; the log stays until `compact`."""
        rows, snap = self._classified()
        boundary = F.lit(self.last_index()).cast("bigint").alias("boundary")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        kv = self.state().select(F.lit("kv").alias("part"), "k", "v", "log_index", none("bigint", "client_id"), none("bigint", "seq"), none("string", "fp"), boundary)
        known = rows.filter(F.col("client_id").isNotNull() & F.col("outcome").isin(NEW, state.RECORD))
        last = known.groupBy("client_id").agg(F.max("seq").alias("seq"), F.max_by("fp", "seq").alias("fp"))
        clients = last.select(F.lit("client").alias("part"), none("string", "k"), none("string", "v"), boundary.alias("log_index"), "client_id", "seq", "fp", boundary)
        return sinks.publish(kv.unionByName(clients), f"{self.root}/snapshot")

    def compact(self) -> int:
        """Delete the log files that the last snapshot covers, and say how many. It was persisted first, so nothing is lost."""
        _, boundary = self._snapshot()
        if not boundary:
            return 0
        fs, _ = sinks._fs(self.spark, self.root)
        files = self.spark.read.schema(COMMANDS).parquet(f"{self.root}/log").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max("log_index").alias("last"))
        old = [r["path"] for r in files.filter(F.col("last") <= boundary).toLocalIterator()]
        for path in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)
        return len(old)
