"""Byte layouts: golden bytes, round trips, torn tails and corruption."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import binary as b
from tidelog.functions import formats as f
from tidelog.functions.crc32c import crc32c, crc32c_column
from tidelog.sources import binary_files, sinks


def test_crc32c(spark):
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"") == 0
    assert crc32c(b"6789", crc32c(b"12345")) == 0xE3069283
    assert spark.createDataFrame([(b"123456789",), (None,)], "x binary").select(crc32c_column(F.col("x"))).collect() == [(0xE3069283,), (None,)]


def test_golden_bytes(spark):
    d = spark.createDataFrame([(1, b"x", b"1"), (2, b"x", None)], "op int, k binary, v binary")
    assert [bytes(r[0]).hex() for r in d.select(b.encode_command(F.col("op"), F.col("k"), F.col("v"))).collect()] == ["010100000001000000017831", "0102000000010000000078"]
    assert f.kv_snapshot({b"b": b"2", b"a": b"1"}).hex() == "02" "00000002" "00000001" "00000001" "61" "31" "00000001" "00000001" "62" "32" "00000000"
    assert f.wal_record(1, b"a", b"1").hex() == "0000000f" "01" "00000001" "00000001" "61" "31" "a154884c"


def test_command_round_trip_and_rejection(spark):
    ident = bytes(range(1, 17))
    d = spark.createDataFrame([(1, b"k", b"v", ident, Decimal(7)), (2, b"", None, ident, Decimal(2**63 + 5)), (1, b"k", b"", None, None)], "op int, k binary, v binary, c binary, s decimal(20,0)")
    back = d.select(b.decode_command(b.encode_command(F.col("op"), F.col("k"), F.col("v"), F.col("c"), F.col("s"))).alias("x")).select("x.*").collect()
    assert [(r["error"], r["op"], bytes(r["key"]), bytes(r["value"]), r["client_id"] and bytes(r["client_id"]), r["seq"] and int(r["seq"])) for r in back] == [
        (None, 1, b"k", b"v", ident, 7),
        (None, 2, b"", b"", ident, 2**63 + 5),
        (None, 1, b"k", b"", None, None),
    ]
    bad = [b"", b"\x03" + b"\0" * 9, b"\x01\x05" + b"\0" * 8, b"\x01\x01\x00\x00\x00\x01\x00\x00\x00\x00", b"\x01\x02\x00\x00\x00\x00\x00\x00\x00\x01x", b"\x01\x01\xff\xff\xff\xff\x00\x00\x00\x00"]
    got = spark.createDataFrame([(x,) for x in bad], "x binary").select(b.decode_command(F.col("x"))["error"]).collect()
    assert all(r[0] for r in got)


def test_request_and_response(spark):
    ident = bytes(range(16, 0, -1))
    d = spark.createDataFrame([(1, ident, 3, b"k", b"v"), (2, None, None, b"k", None), (3, ident, 4, b"k", None)], "o int, c binary, s bigint, k binary, v binary")
    got = d.select(b.decode_request(b.encode_request(*[F.col(c) for c in "ocskv"])).alias("x")).select("x.error", "x.operation", "x.seq").collect()
    assert [(r[0], r[1], int(r[2])) for r in got] == [(None, 1, 3), (None, 2, 0), (None, 3, 4)]
    wrong = spark.createDataFrame([(1, None, 3, b"k", b"v"), (2, ident, 1, b"k", None), (3, ident, 4, b"k", b"v"), (9, None, None, b"", None)], "o int, c binary, s bigint, k binary, v binary")
    assert all(r[0] for r in wrong.select(b.decode_request(b.encode_request(*[F.col(c) for c in "ocskv"]))["error"]).collect())
    r = spark.range(1).select(b.decode_response(b.encode_response(F.lit(3), F.lit(b"host:1"), F.lit(None).cast("binary"))).alias("x")).select("x.*").first()
    assert (r["error"], r["status"], bytes(r["leader_hint"]), bytes(r["value"])) == (None, 3, b"host:1", b"")


def entries(n, seed=1):
    r = random.Random(seed)
    return [(1 + i // 7, r.choice((0, 0, 1, 2)), bytes(r.randrange(256) for _ in range(r.randrange(40)))) for i in range(n)]


def test_segments(spark, tmp_path):
    rows = entries(60)
    log = spark.createDataFrame([(i + 11, t, k, c) for i, (t, k, c) in enumerate(rows)], "log_index bigint, term bigint, kind int, command binary")
    path = f"file://{tmp_path}/raft.log"
    sinks.write_segments(log, path, 3, base_index=10, base_term=1, most=600)
    folder = tmp_path / "raft.log.segments" / f.generation_name(3)
    assert len(list(folder.glob("*.seg"))) == 1  # a batch is never split
    got = [(int(r["log_index"]), int(r["term"]), r["kind"], bytes(r["command"])) for r in binary_files.open_log(spark, path).orderBy("log_index").collect()]
    assert got == [(i + 11, *e) for i, e in enumerate(rows)]


def test_torn_tail_only_in_the_last_segment(spark, tmp_path):
    rows = entries(9)
    first, last = f.segment(1, [rows[:3]]), f.segment(4, [rows[3:6], rows[6:]])
    for cut in range(1, len(f.batch(rows[6:]))):
        assert f.decode_segment(last[:-cut], torn_tail=True)[1] == rows[3:6]
    with pytest.raises(f.CorruptFile):
        f.decode_segment(last[:-1])
    for at in range(13, len(first)):  # a flipped bit is found, or read as a torn tail; never as other entries
        broken = bytearray(first)
        broken[at] ^= 1
        try:
            assert f.decode_segment(bytes(broken), torn_tail=True)[1] == []
        except f.CorruptFile:
            pass
    folder = tmp_path / "g"
    folder.mkdir()
    (folder / f.segment_name(1)).write_bytes(first)
    (folder / f.segment_name(4)).write_bytes(last[:-3])
    got = binary_files.segments(spark, f"file://{folder}")
    assert got.count() == 6 and got.filter("recovered").count() == 3
    (folder / f.segment_name(1)).write_bytes(first[:-3])
    with pytest.raises(Exception, match="inside a batch"):
        binary_files.segments(spark, f"file://{folder}").count()
    assert binary_files.segments(spark, f"file://{folder}", quarantine=True).count() == 1


def test_single_file_logs(spark, tmp_path):
    import struct

    rows = entries(5)
    assert f.decode_log_file(f.log_file(4, 2, rows)) == (4, 2, rows)
    old = b"RLG1\x02" + struct.pack(">QQ", 4, 2)
    for t, c in ((3, b"x"), (3, b"")):
        body = struct.pack(">QI", t, len(c)) + c
        body += struct.pack(">I", crc32c(body))
        old += struct.pack(">I", len(body)) + body
    assert f.decode_log_file(old) == (4, 2, [(3, 0, b"x"), (3, 1, b"")])
    for broken in (old[:-1], b"XXXX\x02", old + b"\0"):
        with pytest.raises(f.CorruptFile):
            f.decode_log_file(broken)
    (tmp_path / "old.log").write_bytes(f.log_file(4, 2, rows))
    assert [int(r[0]) for r in binary_files.open_log(spark, f"file://{tmp_path}/old.log").orderBy("log_index").collect()] == [5, 6, 7, 8, 9]
    assert binary_files.open_log(spark, f"file://{tmp_path}/none.log").count() == 0


def test_wal(spark, tmp_path):
    data = f.wal_record(1, b"a", b"1") + f.wal_record(2, b"a")
    assert f.decode_wal(data + f.wal_record(1, b"b", b"2")[:-2]) == ([(1, b"a", b"1"), (2, b"a", b"")], len(data))
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(f.CorruptFile):
        f.decode_wal(bytes(broken))
    d = spark.createDataFrame([(0, 1, b"a", b"1"), (1, 2, b"a", None)], "position bigint, op int, key binary, value binary")
    sinks.write_wal(d, f"file://{tmp_path}/w")
    assert (tmp_path / "w").read_bytes() == data
    assert [(r[0], r[1], bytes(r[2])) for r in binary_files.wal(spark, f"file://{tmp_path}/w").collect()] == [(0, 1, b"a"), (1, 2, b"a")]


def test_snapshots_and_metadata(spark, tmp_path):
    inner = f.kv_snapshot({b"k": b"", b"a": b"v"}, {bytes(range(1, 17)): (9, b"\x07" * 32, 1)})
    (tmp_path / "kv").write_bytes(inner)
    (tmp_path / "snap").write_bytes(f.snapshot_file(2**63 + 1, 4, inner, {2: "b:1", 1: "a:1"}))
    (tmp_path / "state").write_bytes(f.state_file(5, 3))
    (tmp_path / "commit").write_bytes(f.commit_file(77))
    at = lambda n: f"file://{tmp_path}/{n}"
    assert [(bytes(r[0]), bytes(r[1])) for r in binary_files.kv_snapshot(spark, at("kv")).collect()] == [(b"a", b"v"), (b"k", b"")]
    assert [(int(r[1]), r[3]) for r in binary_files.kv_snapshot(spark, at("kv"), "clients").collect()] == [(9, 1)]
    s = binary_files.snapshot_file(spark, at("snap")).first()
    assert int(s[0]) == 2**63 + 1 and bytes(s[2]) == inner and [v["addr"] for v in s[3]] == ["a:1", "b:1"] and s[4]
    assert list(map(int, binary_files.term_and_vote(spark, at("state")).first())) == [5, 3]
    assert int(binary_files.commit_index(spark, at("commit")).first()[0]) == 77
    assert f.decode_snapshot_file(f.snapshot_file(1, 1, b"x"))[3] is None
    for data, decode in ((f.state_file(5, None), f.decode_state), (f.commit_file(7), f.decode_commit), (f.manifest(1, 2, 3), f.decode_manifest), (f.snapshot_file(1, 1, b"x"), f.decode_snapshot_file)):
        for bad in (data[:-1], data + b"\0", data[:6] + bytes((data[6] ^ 1,)) + data[7:]):
            with pytest.raises(f.CorruptFile):
                decode(bad)


def test_memberships(spark):
    stable, joint = f.Membership(stable={1: "a", 2: "b"}), f.Membership(old={1: "a"}, new={1: "a", 3: "c"})
    assert f.decode_membership(f.membership(joint)) == joint
    d = spark.createDataFrame([(4, 2, f.membership(stable)), (5, 2, f.membership(joint)), (6, 2, b"junk"), (7, 0, b"x")], "log_index bigint, kind int, command binary")
    got = binary_files.memberships(d).orderBy("log_index").collect()
    assert [(int(r[0]), r[1]) for r in got] == [(4, 1), (5, 2)] and [v["addr"] for v in got[1]["new_voters"]] == ["a", "c"]


def test_publish_swaps_tables(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for n in (1, 2, 3):
        sinks.publish(spark.range(n), root)
        assert sinks.current(spark, root).count() == n
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2
