"""Positions of pattern matches in whole texts, from built-in functions alone.

Spark has no function for match offsets. `split` and `regexp_extract_all` walk the same matches, so
the n + 1 pieces between them and the n matches give every offset as a running total of lengths.
Offsets count code points. No row leaves its partition: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,match:string,left:string,right:string>"
#: Running totals are taken in blocks of so many, which keeps a text of n matches below n * sqrt-like cost.
BLOCK = 128


@dataclass(frozen=True)
class Finder:
    """A kind of span. `guard` is a cheap test that every matching text passes; `keep` tests one match."""

    kind: str
    pattern: str
    guard: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None


def running_totals(numbers: Column) -> Column:
    """Inclusive running totals of an array<bigint> column (a plain column, as it is used many times)."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))
    before = lambda b: total(F.slice(numbers, 1, b * BLOCK))
    short = F.transform(numbers, lambda _, i: total(F.slice(numbers, 1, i + 1)))
    part = lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))
    long = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.transform(F.array(before(b)), lambda s: F.struct(s.alias("s"), part(b).alias("p"))),
                lambda e: F.transform(e["p"], lambda _, i: e["s"] + total(F.slice(e["p"], 1, i + 1))),
            )[0],
        )
    )
    return F.when(F.size(numbers) <= BLOCK, short).otherwise(long)


def with_spans(df: DataFrame, text: str, finders: Mapping[str, Finder], context: int = 0) -> DataFrame:
    """Add one array column of spans for each entry of `finders`, named by its key; `text` goes.

    With `context`, each span carries that many code points on its left and right, as far as the
    neighbouring match. Null texts are empty; a text without matches gives an empty array.
    """
    names = list(finders)
    others = [c for c in df.columns if c != text]  # callers keep names that could clash in a struct
    whole = df.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__t"))

    def parts(f: Finder) -> list[Column]:
        t, hit = F.col("__t"), f.guard(F.col("__t"))
        none = F.array().cast("array<string>")
        return [
            F.when(hit, F.regexp_extract_all(t, F.lit(f.pattern), F.lit(0))).otherwise(none),
            F.when(hit, F.split(t, f.pattern, -1)).otherwise(none),
        ]

    cols = []
    for i, n in enumerate(names):
        found, gaps = parts(finders[n])
        cols += [found.alias(f"__m{i}"), gaps.alias(f"__g{i}")]
    pieces = whole.select(*others, *cols)

    def stretch(i: int) -> Column:
        gaps = F.col(f"__g{i}")
        return F.transform(F.col(f"__m{i}"), lambda m, k: (F.length(m) + F.length(gaps[k])).cast("bigint")).alias(f"__n{i}")

    sizes = pieces.select(
        *others,
        *[c for i in range(len(names)) for c in (f"__m{i}", f"__g{i}")],
        *[stretch(i) for i in range(len(names))],
    )
    ends = sizes.select(*sizes.columns, *[running_totals(F.col(f"__n{i}")).alias(f"__e{i}") for i in range(len(names))])

    def spans(i: int, f: Finder) -> Column:
        gaps, end = F.col(f"__g{i}"), F.col(f"__e{i}")
        around = lambda side, c: (F.right if side else F.left)(c, F.lit(context)) if context else F.lit("")
        out = F.transform(
            F.col(f"__m{i}"),
            lambda m, k: F.struct(
                (end[k] - F.length(m)).cast("bigint").alias("start"),
                F.lit(i).alias("rank"),
                F.lit(f.kind).alias("kind"),
                end[k].alias("end"),
                m.alias("match"),
                around(1, gaps[k]).alias("left"),
                around(0, gaps[k + 1]).alias("right"),
            ),
        )
        return F.filter(out, lambda s: f.keep(s["match"])) if f.keep else out

    return ends.select(*others, *[spans(i, finders[n]).alias(n) for i, n in enumerate(names)])


def joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then rank, comma-joined."""
    short = F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    return F.array_join(F.transform(F.array_sort(short), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps_none(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))
