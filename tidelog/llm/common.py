"""What the operators of this subpackage share: table access, shared storage, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space characters of the contracts, and what a word of either kind is.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words of either kind.
_BETWEEN = {WORD: r"[\x20\x09-\x0D]+", PLAIN_WORD: r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one stands in only where the driver is the one executor, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: columnar, unlike `cut`, for what several steps scan."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> bool:
    """Whether a table has at most `most` rows, by counting no more than one over that."""
    return df.limit(most + 1).count() <= most


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; other letters stay, unlike with `lower`."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """A text, or the empty one for a null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column, pattern: str = WORD) -> Column:
    """All words of a text; an empty array for null. Cutting at what is between words is several times faster than matching them."""
    return F.array_remove(F.split(whole(text), _BETWEEN[pattern], -1), "")


def plan_partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
