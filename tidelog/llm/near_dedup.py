"""Near-duplicates by b-bit MinHash.

1. Sketch: each text's shingle set gets HASHES minima. Whole minima of ROWS hashes make one band key; the low BITS
   of every minimum are packed into a signature.
2. Candidates: texts that share a band key. Instead of all pairs of a bucket, every member is tied to the bucket's
   smallest one, and components of these ties are the clusters in which every candidate pair lies.
3. Confirmation: clusters are dealt out in blocks (pairs of chunks of at most about CHUNK texts), so no task gets an
   unbounded group. Within a block, pairs that aren't connected yet are screened by the collision-corrected similarity of
   their packed signatures (bit counts) and the size ratio, and confirmed on full sets. Blocks give confirmed links only, at
   most one less than they have texts.
4. Components of the confirmed links.

Exact copies are one node (a 64-bit hash of the text; two texts of n share one with a probability of about
n * n / 2 ** 65), so copies are neither paired nor compared. Sets hold 64-bit hashes of shingles.

A linked pair at the similarity bound itself shares no band with a probability of 3e-9 at 0.85 and 3e-6 at 0.8,
and the screen's margin is SIGMAS standard errors. The blocks of a cluster grow with the square of its chunks, and each
gets its texts: that is the exact way, not a cap.

Defined results: null, empty and white texts have no shingles and are linked with nothing; short texts are one shingle;
repeated rows are rows of their own with one label; null ids sort after all others, and a component of null ids alone
has a null label; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, whole
from .components import components

ROWS, BANDS, BITS, SIGMAS, CHUNK = 6, 42, 4, 5.0, 1000
HASHES = ROWS * BANDS
_LOW = np.uint64(0x1111111111111111)
_NONE = np.empty(0, np.int64)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return (r.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None], r.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


_A, _B = _constants()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text. `bytes` lower-cases and splits by ASCII alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    z = np.zeros(n, np.uint64)
    for j in range(min(width, len(words))):
        z = (z ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(z ^ (z >> np.uint64(32)))


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys: int64[BANDS], packed signature: uint64[16]) of a non-empty set."""
    x = s.astype(np.uint32)
    least = np.full((HASHES, 1), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (_A * x[None, i : i + 2048] + _B).min(axis=1, keepdims=True), out=least)
    least = least[:, 0]
    key = np.full(BANDS, 0x51ED270B, np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    key = (key + np.arange(BANDS, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    low = np.zeros(256, np.uint64)
    low[:HASHES] = (least ^ (least >> np.uint32(16))) & np.uint32(15)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return key.view(np.int64), np.bitwise_or.reduce(low.reshape(16, 16) << shifts, axis=1)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a packed signature with many, from bit counts."""
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    equal = 1 - np.bitwise_count(x & _LOW).sum(axis=-1) / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, offsets, packed = [], [], [0], []
            for t in b.column("text"):
                s = shingles(t.as_py(), width)
                sizes.append(len(s))
                bands, signature = sketch(s) if len(s) else (_NONE, None)
                keys.append(bands)
                packed.append(None if signature is None else signature.tobytes())
                offsets.append(offsets[-1] + len(bands))
            flat = np.concatenate(keys) if keys else _NONE
            yield pa.record_batch([b.column("id"), b.column("node"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))], names=["id", "node", "n_shingles", "packed", "bands"])

    return run


def _bound(percent: int) -> float:
    """The least estimated similarity that isn't screened out."""
    bound = percent / 100
    return bound - SIGMAS * (1 + 2.0**-BITS) * (bound * (1 - bound) / HASHES) ** 0.5


class _Sets:
    """Shingle sets of a block, made when they are first asked for."""

    def __init__(self, texts: list[str], width: int):
        self.texts, self.width, self.made = texts, width, {}

    def linked(self, i: int, j: int, percent: int) -> bool:
        for k in (i, j):
            if k not in self.made:
                self.made[k] = shingles(self.texts[k], self.width)
        a, b = self.made[i], self.made[j]
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= percent * (len(a) + len(b) - common)


def _likely(packed: np.ndarray, sizes: np.ndarray, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Those of `rest` that may be linked with i, by sizes and signatures."""
    rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])]
    return rest[similarity(packed[i], packed[rest]) >= _bound(percent)] if len(rest) else rest


def links_within(nodes: np.ndarray, texts: list[str], percent: int, width: int = 5, packed: np.ndarray | None = None, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links that connect all that are linked in the block; at most len(nodes) - 1."""
    order = np.argsort(nodes)
    nodes, texts = nodes[order], [texts[i] for i in order]
    sets = _Sets(texts, width)
    if packed is None:
        packed = np.array([sketch(shingles(t, width))[1] for t in texts])
    else:
        packed = packed[order]
    sizes = np.array([len(shingles(t, width)) for t in texts]) if sizes is None else sizes[order]
    part = np.arange(len(nodes))
    out = []
    for i in range(len(nodes) - 1):
        rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        if not len(rest):
            continue
        for j in _likely(packed, sizes, i, rest, percent):
            if part[i] != part[j] and sets.linked(i, j, percent):
                part[part == part[j]] = part[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _confirm(percent: int, width: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        packed = np.frombuffer(b"".join(block["packed"]), np.uint64).reshape(len(block), -1)
        found = links_within(block["node"].to_numpy(), block["text"].tolist(), percent, width, packed, block["n_shingles"].to_numpy())
        return pd.DataFrame({"src": [a for a, _ in found], "dst": [b for _, b in found]}, dtype="int64")

    return run


def labels(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """(id, node, n_shingles, component, first): a row for each row of `docs`; component: the smallest id that can be reached; first: the node that has it."""
    spark = docs.sparkSession
    shared_dir(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(whole(F.col(f"`{text}`"))).alias("node"), F.col(f"`{text}`").cast("string").alias("text"))
    sketched = cut(src.mapInArrow(_sketches(width), "id bigint, node bigint, n_shingles bigint, packed binary, bands array<bigint>"))
    keys = sketched.select(F.explode("bands").alias("key"), "node")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    ties = keys.join(hubs, "key").filter("node != hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")).distinct()
    clusters = components(ties)
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = clusters.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    signed = sketched.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("packed").alias("packed"))
    texts = src.groupBy("node").agg(F.first("text").alias("text")).join(chunked, "node").join(signed, "node")
    # Chunk c meets every other chunk; one or two chunks are a single block.
    single = F.col("chunks") < 3
    dealt = texts.withColumn("other", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))).filter(single | (F.col("other") != F.col("chunk")))
    blocks = dealt.select(
        "node",
        "text",
        "n_shingles",
        "packed",
        "label",
        F.when(single, 0).otherwise(F.least("chunk", "other")).alias("low"),
        F.when(single, 0).otherwise(F.greatest("chunk", "other")).alias("high"),
    )
    confirmed = cut(blocks.groupBy("label", "low", "high").applyInPandas(_confirm(percent, width), "src bigint, dst bigint"))
    groups = components(confirmed)
    nodes = sketched.groupBy("node").agg(F.min("id").alias("low_id")).join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = nodes.groupBy("label").agg(F.min(F.struct(F.col("low_id").isNull(), "low_id", "node")).alias("low"))
    named = nodes.join(low, "label").select("node", F.col("low.low_id").alias("component"), F.col("low.node").alias("first"))
    # Texts without shingles are linked with nothing, not even with their copies.
    full = sketched.select("id", "node", "n_shingles").join(named, "node", "left")
    own = lambda c, alone: F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.col(alone)).alias(c)
    return full.select("id", "node", "n_shingles", own("component", "id"), own("first", "node"))


def report(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The contract's columns for a table with doc_id and text."""
    out = labels(docs, percent=percent)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of `docs` (with doc_id and text) for each group of linked rows: one with the smallest id, null ids last.

    Texts without shingles are linked with nothing, but of rows with equal id and text one stays.
    """
    found = cut(labels(docs, percent=percent).groupBy("id", "node", "component", "first").agg(F.count("*").alias("n")).select(F.col("id").alias("__id"), F.col("node").alias("__node"), (F.col("id").eqNullSafe(F.col("component")) & (F.col("node") == F.col("first"))).alias("kept"), "n"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("bigint").alias("__i"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__n"))
    same = F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__node"))
    repeated = found.filter("kept and n > 1")
    if not repeated.limit(1).count():
        return rows.join(found.filter("not kept"), same, "left_anti").select("__row.*")
    once = rows.join(found.filter("not kept or n > 1"), same, "left_anti").select("__row")
    more = rows.join(repeated, same, "left_semi").groupBy("__i", "__n").agg(F.first("__row").alias("__row")).select("__row")
    return once.unionByName(more).select("__row.*")
