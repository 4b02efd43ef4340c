"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next stage's documents.

Defined results: null and empty texts fail the quality rules (fewer than 50 words); a text that line dedup empties stays as
an empty text, is linked with nothing and has no words, so later stages keep it with a size of 0; of repeated rows one
stays; very long texts are judged whole; other columns pass all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tidelog.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the threshold table keep."""
    judged = quality.judged(docs.select(F.struct("*").alias("__row"), "text"))
    return judged.filter("kept").select("__row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; documents that lose all their words stay, as empty texts."""
    return line_dedup.cleaned(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dedup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in training order."""
    return mixing.report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The stages are held against a brute-force version: SQL can't state the near-dedup and mixing stages at this size.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`. A stage's table goes when the next one is written; the last one's input stays, as its result is lazy."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _drop(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
