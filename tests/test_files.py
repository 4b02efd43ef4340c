"""Files that are replaced, published and read under failure."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import formats as f
from tidelog.functions import text
from tidelog.functions.crc32c import crc32c, crc32c_many
from tidelog.operators import evidence, handlers
from tidelog.sources import binary_files, sinks
from tidelog.streaming import apply

ROWS = "log_index bigint, k string, op string, v bigint, outcome string"


def test_a_writer_that_dies_loses_nothing(spark, tmp_path):
    """A generation without its commit mark, which is what a writer leaves that dies before the last step, isn't current."""
    root = f"file://{tmp_path}/state"
    handle = apply.state_table_updater(root)
    batch = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    handle(batch((1, "a", "PUT", 1, "NEW"), (2, "b", "PUT", 2, "NEW")), 0)
    name = sinks.generations(spark, root)[-1]
    torn = tmp_path / "state" / f.generation_name(sinks.generation_number(name) + 1)
    torn.mkdir()
    (torn / "part-00000.parquet").write_bytes(b"half")
    assert sorted(r["k"] for r in sinks.current(spark, root).collect()) == ["a", "b"]
    handle(batch((3, "c", "PUT", 3, "NEW")), 1)
    assert sorted(r["k"] for r in sinks.current(spark, root).collect()) == ["a", "b", "c"]


def test_replacing_a_file(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    for content in (b"one", b"another"):
        sinks.put_bytes(spark, path, content)
        assert bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]) == content
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


def test_gaps_between_segments_fail_the_read(spark, tmp_path):
    entry = (1, 0, b"x")
    for start in (1, 10):
        (tmp_path / f.segment_name(start)).write_bytes(f.segment(start, [[entry, entry]]))
    folder = f"file://{tmp_path}"
    with pytest.raises(Exception, match="starts at 10"):
        binary_files.segments(spark, folder).collect()
    assert binary_files.segments(spark, folder, check=False).count() == 4
    (tmp_path / f.segment_name(10)).unlink()
    (tmp_path / f.segment_name(3)).write_bytes(f.segment(3, [[entry]]))
    assert binary_files.segments(spark, folder).count() == 3
    assert binary_files.segments(spark, folder, base_index=0).count() == 3
    with pytest.raises(Exception, match="starts at 1 "):
        binary_files.segments(spark, folder, base_index=5).collect()
    (tmp_path / f.segment_name(2)).write_bytes(f.segment(2, [[entry]]))
    with pytest.raises(Exception, match="continue"):
        binary_files.segments(spark, folder).collect()


def test_segments_of_many_partitions(spark, tmp_path):
    log = spark.range(1, 3001).select(F.col("id").alias("log_index"), F.lit(1).alias("term"), F.lit(0).alias("kind"), F.col("id").cast("string").cast("binary").alias("command")).repartition(7)
    path = f"file://{tmp_path}/log"
    sinks.write_segments(log, path, 1, most=4000)
    assert len(list((tmp_path / "log.segments" / f.generation_name(1)).glob("*.seg"))) > 10
    got = binary_files.open_log(spark, path).orderBy("log_index").select("command").collect()
    assert [int(bytes(r[0])) for r in got] == list(range(1, 3001))
    with pytest.raises(Exception, match="after|instead"):
        sinks.write_segments(log.filter("log_index <> 1500"), f"file://{tmp_path}/other", 1)


def test_checksums_side_by_side():
    records = [bytes([i % 251]) * (i * 37 % 900) for i in range(300)] + [b"y" * 20_000, b""]
    assert crc32c_many(records).tolist() == [crc32c(r) for r in records]
    assert crc32c_many([]).tolist() == []


def test_arguments():
    assert text.node_arguments(1, "a:1", "/d", ["2=b:1", "3=c=1"]) == {2: "b:1", 3: "c=1"}
    for bad in ((0, "a", "d", []), (1, "", "d", []), (1, "a", "", []), (1, "a", "d", ["2"]), (1, "a", "d", ["0=b"]), (1, "a", "d", ["2=b", "2=c"]), (1, "a", "d", ["2=b", "3=b"]), (1, "a", "d", ["1=b"])):
        with pytest.raises(text.BadArguments):
            text.node_arguments(*bad)
    with pytest.raises(text.BadArguments):
        text.client_arguments([], 1)


def test_schema_versions(spark):
    good = spark.createDataFrame([(1,)], "schema_version int")
    assert evidence.versioned(good).count() == 1
    with pytest.raises(Exception, match="version 2"):
        evidence.versioned(good.withColumn("schema_version", F.lit(2))).collect()


def test_chunks_of_a_snapshot():
    assert handlers.chunks(b"abcde", 2) == [(0, b"ab", False), (2, b"cd", False), (4, b"e", True)]
    assert handlers.chunks(b"", 2) == [(0, b"", True)]
