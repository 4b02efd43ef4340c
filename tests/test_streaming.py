"""The streamed apply loop equals the batch fold, over several micro-batches and a restart."""

from pyspark.sql import functions as F

from tidelog.api import Store
from tidelog.operators import state
from tidelog.plans import events as ev
from tidelog.sources import sinks
from tidelog.streaming import apply

SCHEMA = "log_index bigint, client_id bigint, seq bigint, k string, op string, v bigint, fp string"


def drain(log, out, checkpoint):
    apply.classified_stream(log).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch(spark, small, tmp_path):
    log = ev.anomaly_log(ev.events(spark, small)).select("log_index", "client_id", F.col("seq").cast("bigint").alias("seq"), "k", "op", "v", "fp")
    folder, out, check = (f"file://{tmp_path}/{n}" for n in ("log", "out", "check"))
    parts = [(0, 300), (300, 700), (700, 10**9)]
    for n, (low, high) in enumerate(parts):
        log.filter((F.col("log_index") > low) & (F.col("log_index") <= high)).coalesce(1).write.mode("append").parquet(folder)
        if n:  # the second run continues from the first one's checkpoint
            drain(apply.read_log(spark, folder, SCHEMA, 1), out, check)
    want = sorted(map(tuple, state.classify(log).select("log_index", "outcome").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select("log_index", "outcome").collect())) == want


def test_state_table(spark, tmp_path):
    rows = [(1, "a", "PUT", 1, "NEW"), (2, "b", "PUT", 2, "NEW"), (3, "a", "PUT", 3, "STALE"), (4, "b", "DELETE", None, "NEW")]
    d = spark.createDataFrame(rows, "log_index bigint, k string, op string, v bigint, outcome string")
    handle = apply.state_table_updater(f"file://{tmp_path}/state")
    for low, high in ((0, 2), (2, 4), (2, 4)):
        handle(d.filter((F.col("log_index") > low) & (F.col("log_index") <= high)), 0)
    got = {r["k"]: (r["op"], r["v"]) for r in sinks.current(spark, f"file://{tmp_path}/state").collect()}
    assert got == {"a": ("PUT", 1), "b": ("DELETE", None)}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.get("x") == ("NOT_FOUND", None)
    assert s.put("x", "1", client=5) == "NEW"
    assert s.put("x", "2", client=5, seq=1) == "CONFLICT"
    assert s.delete("y") == "NEW"
    assert s.put("x", "", client=5) == "NEW"
    assert s.get("x") == ("OK", "") and s.get("x", at=3) == ("OK", "1")
    assert s.status()["last_index"] == 4 and s.status()["live_keys"] == 1


def test_store_reads_its_snapshot(spark, tmp_path):
    """Outcomes and state go on from the snapshot after the log before it is gone."""
    s = Store(spark, f"file://{tmp_path}/store")
    assert [s.put("x", "1", client=5), s.put("y", "2", client=5), s.put("z", "3"), s.delete("z")] == ["NEW"] * 4
    s.snapshot()
    assert s.compact() == 4 and s.log().count() == 0
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.last_index() == 4 and again.get("x") == ("OK", "1") and again.get("z") == ("NOT_FOUND", None)
    assert again.put("y", "2", client=5, seq=2) == "DUPLICATE"
    assert again.put("y", "4", client=5, seq=3) == "NEW"
    assert again.put("w", "0", client=5, seq=1) == "STALE"
    assert {r["k"]: r["v"] for r in again.state().collect()} == {"x": "1", "y": "4"}
    again.snapshot()
    assert {r["k"]: r["v"] for r in again.state().collect()} == {"x": "1", "y": "4"} and again.put("y", "4", client=5, seq=3) == "DUPLICATE"
