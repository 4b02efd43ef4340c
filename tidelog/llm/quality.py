"""Quality rules: a threshold table compiled into one Spark projection.

Each row of a threshold table names a statistic and the range in which it must lie. Statistics are built-in
expressions over the whole text, so the plan is a scan and projections: no shuffle and no user function.

Defined results: null and empty texts have no words and fail; a text's own repeats count within it alone; ties and
repeated rows are rows of their own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, whole

#: Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the of and to in is that it for was with be by on are this at from as or an which have has not "
    "le la les de des du et en un une est que qui dans pour par sur au aux pas avec il elle se ce ne "
    "der die das und ist ein eine zu von mit den dem nicht im auf für sich auch als es an "
    "el los las del y un una por con no su para lo se al más como sus ja o"
).split()


@dataclass(frozen=True)
class Rule:
    """`statistic` must be at least `low` and at most `high`; None leaves a side open."""

    statistic: str
    low: float | None = None
    high: float | None = None


#: Texts under 50 words and highly repetitive ones fail by the contract's base rule; these are the method's own.
RULES = (
    Rule("mean_word", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.35),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("lettered_ratio", 0.55, None),
)


STATISTICS = ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop", "n_lettered", "n_repeat_words")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of `text` to the rows; `text` stays, and columns with the name of a statistic are replaced.

    Windows are compared by 64-bit hashes within one text; two different windows of a text of n words share one with
    a probability of about n * n / 2 ** 65.
    """
    rest = [c for c in docs.columns if c not in STATISTICS]
    t = F.col("__t")
    step = docs.select(*rest, whole(F.col(text)).alias("__t"))
    step = step.select(
        *rest,
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("__w"),
        F.length(F.translate(t, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(F.translate(x, WHITE, " "))) > 0).alias("__l"),
    )
    step = step.select(
        *rest,
        "word_chars",
        "n_symbols",
        F.size("__w").cast("bigint").alias("n_words"),
        F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("__w") >= 3, F.transform(F.slice("__w", 1, F.size("__w") - 2), lambda w, i: F.xxhash64(w, F.col("__w")[i + 1], F.col("__w")[i + 2])))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("__h"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop"),
        F.size(F.filter("__w", lambda w: w.rlike(r"\p{L}"))).cast("bigint").alias("n_lettered"),
    )
    keep = [*rest, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop", "n_lettered"]
    # Most windows are unique: sort plain hashes first, and keep places only for texts that repeat one.
    step = step.select(*keep, "__h", F.size(F.array_distinct("__h")).alias("__d"))
    step = step.select(
        *keep,
        F.when(F.col("__d") < F.size("__h"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"),
    )
    s = F.col("__s")
    step = step.select(
        *keep,
        F.array_sort(F.transform(F.filter(s, lambda e, i: (e["h"] == F.get(s, i + 1)["h"]) | (e["h"] == F.get(s, i - 1)["h"])), lambda e: e["i"])).alias("__p"),
    )
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return step.select(*keep, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def ratios(df: DataFrame) -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "mean_word": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "stop_ratio": over("n_stop", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "lettered_ratio": over("n_lettered", "n_words"),
    }


def compiled(rules: tuple[Rule, ...], of: dict[str, Column]) -> Column:
    """The conjunction of all rules."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (of[r.statistic] >= F.lit(r.low))
        if r.high is not None:
            out = out & (of[r.statistic] <= F.lit(r.high))
    return out


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Add statistics, base_failed and kept to the rows of `docs`.

    Both verdicts depend on a row number, which keeps the optimizer from pushing a filter on them down through the
    projections: it would write the statistics out, again and again, into one huge condition.
    """
    stats = statistics(docs.drop("base_failed", "kept"), text).withColumn("__fence", F.monotonically_increasing_id())
    here = F.col("__fence") >= 0
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~F.col("base_failed") & compiled(rules, ratios(stats))
    return stats.withColumn("base_failed", failed & here).withColumn("kept", kept & here).drop("__fence")


def report(docs: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
