"""Secret scanning over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a table in the shared folder with a row
for each pair of blob and rule version that was scanned; `update` scans the pairs that it lacks, each blob once however many
paths hold it, and appends them. Findings are the ledger's rows, joined back to all paths. Base kinds (assign, access, hex)
are exact patterns; further rules add well-known key formats.

The query takes the table in as a history of PASSES commits, each row in one of them: a later one scans only blobs that none
before it had.

Scale: one shuffle brings a copy of each unseen blob together (copies merge before it), and one joins blobs with findings
back to paths. That join is salted, so a blob held by a third of all paths is spread over `SALTS` tasks and more where Spark
splits skewed partitions. An append is one committed write: a run that dies leaves the ledger as it was, and the next one
scans what is missing.

Defined results: null texts are empty; ties and repeated rows are rows of their own; an empty table gives an empty
result; a pair that is in the ledger twice counts once; all other columns, whatever their names, are in the struct `row`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .spans import Finder, joined, overlaps_none, with_spans

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE = {
    "assign": Finder("assign", ASSIGN, lambda t: t.rlike(r"(?i:passw|secret|token|api_?key)"), lambda m: F.length(F.regexp_replace(m, _VALUE, "")) >= 12),
    "access": Finder("access", r"AKIA[A-Z0-9]{14,}+", lambda t: F.contains(t, F.lit("AKIA"))),
    "hex": Finder("hex", r"[0-9a-f]{16,}+", lambda t: t.rlike(r"[0-9a-f]{16}")),
}
#: Published key formats beyond the base kinds.
RULES = {
    "pem": Finder("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", lambda t: F.contains(t, F.lit("PRIVATE KEY-----"))),
    "jwt": Finder("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda t: F.contains(t, F.lit("eyJ"))),
    "forge": Finder("forge", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+)", lambda t: t.rlike(r"gh[pousr]_|glpat-")),
    "chat": Finder("chat", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", lambda t: F.contains(t, F.lit("xox"))),
    "url": Finder("url", r"[a-z][a-z0-9+]{1,20}://[^\x20/:@\"']{1,64}:[^\x20/@\"']{3,64}@[A-Za-z0-9.-]{3,}+", lambda t: t.rlike(r"://[^\x20/@]*:[^\x20/@]*@")),
}
RULE_VERSION = 1
SALTS, PASSES = 16, 2
LEDGER = "blob string, rule_version int, base array<struct<start:bigint,rank:int,kind:string,end:bigint>>, added array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def scan(blobs: DataFrame, content: str = "content", rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows for blobs (blob, content): the base spans, and spans of other rules that overlap none of them."""
    found = with_spans(blobs.select("blob", content), content, BASE | RULES)
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    both = found.select("blob", F.concat(*BASE).alias("b"), F.concat(*RULES).alias("a"))
    return both.select("blob", F.lit(rule_version).alias("rule_version"), slim(F.col("b")).alias("base"), slim(F.filter("a", lambda s: overlaps_none(s, F.col("b")))).alias("added"))


def _row(paths: DataFrame, content: str) -> Column:
    """All columns but the content, as a struct: their names clash with nothing."""
    rest = [c for c in paths.columns if c != content]
    return (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("string").alias("__none"))).alias("row")


def _content(content: str) -> Column:
    return F.coalesce(F.col(f"`{content}`").cast("string"), F.lit(""))


def unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: int = RULE_VERSION) -> DataFrame:
    """One row (blob, content) for each blob of (blob, content) that the ledger lacks for this rule version."""
    if ledger is not None:
        versions = versions.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return versions.groupBy("blob").agg(F.first("content").alias("content"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows, a pair once; empty before the first update."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        kinds = dict(c.split(" ", 1) for c in LEDGER.split(", "))
        return spark.range(0).select(*[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    return spark.read.schema(LEDGER).parquet(path).groupBy("blob", "rule_version").agg(F.first("base").alias("base"), F.first("added").alias("added"))


def update(paths: DataFrame, content: str, path: str, rule_version: int = RULE_VERSION) -> None:
    """Scan the blobs of `paths` that the ledger at `path` lacks for this rule version, and append them to it."""
    versions = paths.select(F.sha2(_content(content), 256).alias("blob"), _content(content).alias("content"))
    scan(unseen(versions, read_ledger(paths.sparkSession, path), rule_version), rule_version=rule_version).write.mode("append").parquet(path)


def findings(paths: DataFrame, content: str, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """(row, blob, base, added) for every row of `paths`; the ledger has all of its blobs, and each once."""
    hits = ledger.filter((F.col("rule_version") == rule_version) & ((F.size("base") > 0) | (F.size("added") > 0))).select(
        "blob", "base", "added", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    keyed = paths.select(_row(paths, content), F.sha2(_content(content), 256).alias("blob")).withColumn("salt", F.pmod(F.xxhash64(F.to_json("row")), F.lit(SALTS)).cast("int"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return keyed.join(hits, ["blob", "salt"], "left").select("row", "blob", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def run(paths: DataFrame, content: str, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """`update` the ledger at `path`, then the `findings` of all rows from it."""
    update(paths, content, path, rule_version)
    return findings(paths, content, read_ledger(paths.sparkSession, path), rule_version)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns for a table with doc_id and text. `path`: a ledger to go on with; a new one if none is given."""
    docs = docs.select("doc_id", "text")
    path = path or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    for commit in range(PASSES):
        update(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PASSES)) == commit), "text", path)
    found = findings(docs, "text", read_ledger(docs.sparkSession, path))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
