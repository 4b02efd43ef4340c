"""Line deduplication with two Bloom filters.

1. Every partition hashes its lines' keys into a once-seen and a twice-seen filter: a bit of the second is set where
   a key sets a bit that is set already. Filters are merged by segments, first in groups of partitions, then over all:
   what is set in two of them counts as twice-seen.
2. Keys whose bits are all in the twice-seen filter are suspected repeats. Only they are shuffled, as 128-bit hashes,
   for exact counts and the choice of the occurrence that stays.
3. Keys found often enough are joined to the documents that hold them, and these drop their lines.

The filter is broadcast: it has 2 ** bits bits, chosen from the table's bytes and at most MAX_BITS (64 MB), a bound that
doesn't grow with the data. A fuller filter suspects more keys; results stay the same. Filters are packed bits also while
they are filled. A text travels once, beside the keys that it loses, and its lines are dropped by built-in functions.

Defined results: null and empty texts are one empty line; a key in a row twice counts once; rows with equal ids are
documents of their own that decide alike; null ids sort before all others; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut, shared_dir, whole

MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 16
SEGMENT_BITS, LEAST_BITS, MAX_BITS, PROBES = 20, 20, 29, 4
#: So many keys are hashed at a time, which bounds a worker's memory whatever a batch of texts holds.
AT_ONCE = 32768
_WHITE_BYTES = WHITE.encode()


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The stripped line with A-Z lower-cased, or None if it is too short. `bytes.lower` changes ASCII alone."""
    line = line.strip(_WHITE_BYTES)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return line.lower()


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """PROBES filter places of each key, from two halves of one hash."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64((1 << bits) - 1)


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := key_of(line, min_chars)) is not None}


def _gathered(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[list[bytes]]:
    """The keys of all texts, about AT_ONCE at a time; a key twice in a text counts once."""
    keys: list[bytes] = []
    for b in batches:
        for t in b.column(0):
            keys.extend(_keys(t.as_py() or b"", min_chars))
            if len(keys) >= AT_ONCE:
                yield keys
                keys = []
    if keys:
        yield keys


def _masks(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte number and bit mask of filter places."""
    return (places >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (places & np.uint64(7)).astype(np.uint8)


def _set(filt: np.ndarray, places: np.ndarray) -> None:
    """Set sorted places of a packed filter, those of one byte together."""
    at, mask = _masks(places)
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        filt[at[first]] |= np.bitwise_or.reduceat(mask, first)


def _filters(bits: int, min_chars: int):
    segment = 1 << (min(bits, SEGMENT_BITS) - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, share = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8), 0
        for keys in _gathered(batches, min_chars):
            flat = np.sort(_places(keys, bits), axis=None)
            share = share or int(flat[0]) & 63
            _set(twice, flat[1:][flat[1:] == flat[:-1]])
            at, mask = _masks(flat)
            _set(twice, flat[(once[at] & mask) != 0])
            _set(once, flat)
        for k in range(0, len(once), segment):
            if once[k : k + segment].any():
                yield pa.record_batch([pa.array([k // segment], pa.int32()), pa.array([share], pa.int32()), pa.array([_packed(once[k : k + segment])], pa.binary()), pa.array([_packed(twice[k : k + segment])], pa.binary())], names=["segment", "share", "once", "twice"])

    return run


def _packed(part: np.ndarray) -> bytes:
    return zlib.compress(part.tobytes(), 1)


def _bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for o, t in zip(group["once"], group["twice"], strict=True):
        o, t = _bits(o), _bits(t)
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pd.DataFrame({"segment": [group["segment"].iloc[0]], "share": [0], "once": [_packed(once)], "twice": [_packed(twice)]})


def twice_seen(docs: DataFrame, text: str, bits: int, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The twice-seen filter over all lines of all rows, as packed bytes."""
    schema = "segment int, share int, once binary, twice binary"
    made = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_filters(bits, min_chars), schema)
    merged = made.groupBy("segment", "share").applyInPandas(_merge, schema).groupBy("segment").applyInPandas(_merge, schema)
    size = 1 << (min(bits, SEGMENT_BITS) - 3)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in merged.select("segment", "twice").toLocalIterator():
        out[r["segment"] * size : (r["segment"] + 1) * size] = _bits(r["twice"])
    return out


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(shared.value, np.uint8)

        def tested(b: pa.RecordBatch, rows: list[int], keys: list[bytes]) -> pa.RecordBatch:
            at, mask = _masks(_places(keys, bits))
            own = np.flatnonzero((filt[at] & mask).astype(bool).all(axis=1))
            return pa.record_batch([b.column("id").take(pa.array(np.array(rows, np.int64)[own])), pa.array([digest(keys[i]) for i in own], pa.binary())], names=["id", "key"])

        for b in batches:
            rows, keys = [], []
            for i, t in enumerate(b.column("text")):
                own = _keys(t.as_py() or b"", min_chars)
                keys.extend(own)
                rows.extend([i] * len(own))
                if len(keys) >= AT_ONCE:
                    yield tested(b, rows, keys)
                    rows, keys = [], []
            if keys:
                yield tested(b, rows, keys)

    return run


def digest(key: bytes) -> bytes:
    """What a key is shuffled as; SQL has it as unhex(md5(key))."""
    return hashlib.md5(key, usedforsecurity=False).digest()


def _kept(lines: Column, gone: Column, min_chars: int) -> Column:
    """The lines whose keys aren't in `gone`, which may be null."""
    key = lambda x: ascii_lower(F.btrim(x, F.lit(WHITE)))
    stays = F.filter(lines, lambda x: F.when(F.length(key(x)) >= min_chars, ~F.array_contains(gone, F.unhex(F.md5(key(x))))).otherwise(True))
    return F.when(gone.isNull(), lines).otherwise(stays)


def filter_bits(docs: DataFrame) -> int:
    """A bit for each eight to sixteen bytes of the estimated size, within the bounds: about sixteen for a line."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MAX_BITS, max(LEAST_BITS, (size // 16).bit_length()))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "last", bits: int | None = None) -> DataFrame:
    """(row: struct of the other columns of `docs`, text: what is left of it, n_lines, n_dropped) for every row.

    Keys of at least `min_chars` code points in at least `min_docs` rows lose all their lines but in the rows with the
    largest id ("last") or the smallest ("first").
    """
    spark = docs.sparkSession
    shared_dir(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    bits = bits or filter_bits(src)
    shared = spark.sparkContext.broadcast(twice_seen(src, "text", bits, min_chars).tobytes())
    kind = src.schema["id"].dataType.simpleString()
    suspects = cut(src.mapInArrow(_suspects(shared, bits, min_chars), f"id {kind}, key binary"))
    pick = F.max if keep == "last" else F.min
    often = suspects.groupBy("key").agg(F.count("*").alias("n"), pick("id").alias("stays")).filter(F.col("n") >= min_docs).select("key", "stays")
    # One line may stand in a third of all documents: its rows are spread over SALTS tasks, the short list of keys is repeated.
    spread = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    gone = salted.join(spread, ["key", "salt"]).filter(~F.col("id").eqNullSafe(F.col("stays"))).groupBy(F.col("id").alias("__id")).agg(F.collect_set("key").alias("gone"))
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("string").alias("__none"))
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{text}`")).alias("text"))
    held = rows.join(gone, rows["id"].eqNullSafe(gone["__id"]), "left").select("row", F.split("text", "\n", -1).alias("lines"), "gone")
    left = held.select("row", "lines", _kept(F.col("lines"), F.col("gone"), min_chars).alias("stay"))
    return left.select("row", F.array_join("stay", "\n").alias("text"), F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("bigint").alias("n_dropped"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table with doc_id and text."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, and in `text` what is left of it."""
    out = deduplicated(docs)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
