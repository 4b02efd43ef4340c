"""WARC archives and their index.

Writing: each capture is one WARC 1.1 record. Records are text rows, written by Spark's own text writer with the record
end as line separator, so files are committed task by task to any file system that Spark writes, and a lost executor
costs only its tasks. Files are not compressed as a whole, so an index row's offset is a place that a reader can seek.
A file has so many records that neither the usual nor the longest ones make it larger than the reader can hold. Payloads of
at least MIN_REVISIT bytes that equal an earlier capture's become revisit records without payload; the list of such
payloads' digests is broadcast up to BROADCAST_ROWS rows, and beyond that joined by digest and a salt.

Index: every archive file gives a run of index rows, sorted by URL key and timestamp. Runs are dealt to ranges of that
order, and in each range a loser tree merges the runs, so the ranges in turn are the globally ordered capture history.
A range has about RANGE_ROWS index rows (without payloads) whatever the table's size, and is what a task holds; a URL with
very many captures is split by timestamp.

Reading takes plain archives and gzip files of one or many members.

Defined results: null payloads are empty; the smallest id of equal payloads is the response, and rows that repeat it are
responses too; null ids come last and refer like others; an empty table gives an empty archive and result; columns other
than those named aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plan_partitions, shared_dir, small

MIN_REVISIT = 100
END = "\r\n\r\n"
#: Captures have no time of their own in `pages`: they are taken a second apart from here, in the order of their ids, which wrap around after some thousand years.
EPOCH, SECONDS = 1704067200, 200_000_000_000
#: The usual and the largest size of a file in bytes, rows of an index range, rows of a broadcast list.
FILE_BYTES, MOST_BYTES, RANGE_ROWS, BROADCAST_ROWS, SALTS = 128 << 20, 1 << 30, 200_000, 200_000, 16
RECORD = "page_id bigint, url string, timestamp string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, file string, offset bigint"


def url_key(url: Column) -> Column:
    """A sortable key: host labels reversed and comma-joined, then path and query, lower-cased, without scheme, user, www and fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?|#.*$", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^www[0-9]*\.|:[0-9]*$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def captures(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, bytes, digest, time, record_type, refers_to) of every row."""
    p = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), p.alias("payload"), F.octet_length(p).cast("bigint").alias("bytes"), F.sha2(p, 256).alias("digest"))
    first = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("digest").alias("d"), "first")
    if small(first, BROADCAST_ROWS):
        met = rows.join(F.broadcast(first), (F.col("digest") == F.col("d")) & (F.col("bytes") >= MIN_REVISIT), "left")
    else:  # a payload may be that of a third of all pages
        spread = first.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        met = rows.join(spread, (F.col("digest") == F.col("d")) & (salt == F.col("s")) & (F.col("bytes") >= MIN_REVISIT), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    time = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return met.select("page_id", "url", "payload", "bytes", "digest", time.alias("time"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _record(name: str = "tidelog") -> Column:
    """One record up to its end, as text."""
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]", "%0A")
    urn = lambda c: F.concat(F.lit(f"<urn:{name}:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Date", F.col("time")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", urn(F.col("refers_to"))), line("X-Payload-Length", F.col("bytes").cast("string")))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def records_per_file(pages: DataFrame, payload: str = "html") -> int:
    """So many records that a file of usual ones has about FILE_BYTES, and one of the longest ones at most MOST_BYTES."""
    size = F.octet_length(payload) + 1024
    usual, longest = pages.agg(F.avg(size), F.max(size)).first()
    return max(1, min(int(FILE_BYTES / (usual or 1024)), MOST_BYTES // (longest or 1024)))


def write(pages: DataFrame, path: str, **names: str) -> None:
    """Write one record for each row of `pages` in archive files under `path`."""
    most = records_per_file(pages, names.get("payload", "html"))
    captures(pages, **names).select(_record().alias("value")).write.mode("errorifexists").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


_ID = re.compile(rb"<urn:[a-z]+:(-?[0-9]+|none)>")


def records(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers by lower-case name, payload) of every record of an uncompressed archive; a broken one raises."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at offset {at}")
        lines = data[at:head].split(b"\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(headers[b"content-length"])
        payload = data[head + 4 : head + 4 + size]
        end = head + 4 + size
        if len(payload) != size or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} is cut short")
        yield at, headers, payload
        at = end + 4


def unzipped(data: bytes) -> bytes:
    """The content of all members of a gzip file; zeros may follow them, anything else raises."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            raise ValueError(f"no gzip member where one should begin: {e}") from e
        if not member.eof:
            raise ValueError("the last gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _number(found: bytes | None) -> int | None:
    m = _ID.search(found or b"")
    return int(m.group(1)) if m and m.group(1) != b"none" else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in RECORD.split(", ")]
    batch = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)
    for b in batches:
        for name, content in zip(b.column("path"), b.column("content"), strict=True):
            file, data = name.as_py().rpartition("/")[2], content.as_py()
            data = unzipped(data) if data[:2] == b"\x1f\x8b" else data
            rows: list[tuple] = []
            for at, h, payload in records(data):
                kind, said = h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                    raise ValueError(f"{file}: the payload at offset {at} doesn't have its digest")
                size = len(payload) if kind == "response" else int(h[b"x-payload-length"])
                stamp = re.sub(r"[^0-9]", "", h[b"warc-date"].decode())
                rows.append((_number(h[b"warc-record-id"]), h[b"warc-target-uri"].decode("utf-8", "replace"), stamp, kind, said, size, _number(h.get(b"warc-refers-to")), file, at))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files under `path` (see RECORD), each response verified against its digest."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse, RECORD)


class LoserTree:
    """Merges sorted runs: each step replays one path of the tree, a comparison for each level."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.n = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.n)
        for i in range(self.n):
            self._play(i, fresh=True)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; ended runs go last, ties by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return (kx, a) < (ky, b)

    def _play(self, winner: int, fresh: bool = False) -> None:
        at = (winner + self.n) // 2
        while at > 0:
            if self.tree[at] < 0 and fresh:
                self.tree[at] = winner
                return
            if self._less(self.tree[at], winner):
                winner, self.tree[at] = self.tree[at], winner
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.n and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, which come run by run, in the order of the loser tree. Rows stay Arrow columns; only sort keys are Python's."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    file, keys = t.column("file").to_pylist(), list(zip(t.column("url_key").to_pylist(), t.column("timestamp").to_pylist(), t.column("offset").to_pylist(), strict=True))
    starts = [i for i in range(len(file)) if i == 0 or file[i] != file[i - 1]]
    runs = [iter(range(a, b)) for a, b in zip(starts, [*starts[1:], len(file)], strict=True)]
    order = iter(LoserTree(runs, keys.__getitem__))
    while part := list(itertools.islice(order, 10_000)):
        yield from t.take(pa.array(part, pa.int64())).combine_chunks().to_batches()


def history(archive: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of `read` with url_key, globally ordered by (url_key, timestamp): run by run within ranges, merged by a loser tree. `rows`: how many there are, if that is known."""
    keyed = archive.withColumn("url_key", url_key(F.col("url")))
    ranges = max(plan_partitions(archive), -(-(archive.count() if rows is None else rows) // RANGE_ROWS))
    dealt = keyed.repartitionByRange(ranges, "url_key", "timestamp", "file", "offset")
    runs = dealt.sortWithinPartitions("file", "url_key", "timestamp", "offset")
    return runs.mapInArrow(_merge, f"{RECORD}, url_key string")


def report(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and give the contract's columns in the order of the capture history."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = pages.select("page_id", "url", "html")
    write(pages, path)
    return history(read(spark, path), pages.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
