"""Archives with a gzip member for each record."""

import gzip

import pytest

from tidelog.llm import warc


def test_a_member_for_each_record(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{0}>\r\nWARC-Target-URI: http://a.org/{0}\r\nWARC-Date: 2024-01-01T00:00:0{0}Z\r\nWARC-Payload-Digest: sha256:{1}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record.format(i, digest).encode()) for i in range(5)))
    assert sorted(r["page_id"] for r in warc.read(spark, f"file://{tmp_path}").collect()) == [0, 1, 2, 3, 4]


def test_broken_members():
    a, b = gzip.compress(b"a"), gzip.compress(b"b" * 1000)
    assert warc.unzipped(a + b + b"\0" * 8) == b"a" + b"b" * 1000
    for bad in (a + b"x", a + b[:-3], a + b[:12]):
        with pytest.raises(ValueError, match="gzip"):
            warc.unzipped(bad)


def test_offsets_can_be_sought_and_any_id_is_fine(spark, tmp_path):
    rows = [(2**63 - 1, "http://a.org/x", "é" * 200), (-5, "http://b.org", "<p>y</p>"), (None, None, None), (7, "http://a.org/z", "é" * 200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert len(got) == 4
    for r in got:
        with open(tmp_path / "w" / r["file"], "rb") as f:
            f.seek(r["offset"])
            assert f.read(9) == b"WARC/1.1\r"
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert kinds == {2**63 - 1: ("revisit", 7, 400), -5: ("response", None, 8), None: ("response", None, 0), 7: ("response", None, 400)}
    assert warc.report(pages).count() == 4


def test_large_lists_of_repeated_payloads_are_joined_by_salts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", "x" * (150 + i % 3)) for i in range(60)], "page_id bigint, url string, html string")
    want = sorted(map(str, warc.report(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.report(pages).collect())) == want


def test_files_are_bounded_by_their_longest_records(spark):
    long = spark.createDataFrame([("x" * 3_000_000,), ("y",)], "html string")
    assert warc.records_per_file(long) * 3_001_024 <= warc.MOST_BYTES + 3_001_024 and warc.records_per_file(long.filter("html = 'y'")) > 1000
    assert warc.records_per_file(long.limit(0)) >= 1
