"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

Base kinds (email, ip, card, phone) are exact patterns and are always reported. High-recall generators propose further,
overlapping spans (spelled-out addresses, telephone numbers in national forms, identity numbers, IPv6, dates of birth);
boosted trees see their format and context, and a span is reported if its calibrated probability reaches the threshold of its
generator and no overlapping span is more probable. All of it is one projection of the scan: no shuffle, no user function.

Defined results: null and empty texts give no spans; repeated rows and ties are rows of their own; an empty table gives an
empty result; all other columns, whatever their names, pass through unread.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .spans import SPAN, Finder, joined, overlaps_none, with_spans


def _luhn(match: Column) -> Column:
    digits = F.lpad(F.translate(match, " -", ""), 20, "0")
    total = F.lit(0)
    for i in range(1, 21):
        d = F.substring(digits, i, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


#: The contracts' patterns. Look-behinds and possessive repeats keep a failed attempt from being made anew at
#: each character of a long run; they match the same spans, as what follows a run doesn't depend on its start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {
    "email": Finder("email", EMAIL, lambda t: F.contains(t, F.lit("@"))),
    "ip": Finder("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), lambda m: ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))),
    "card": Finder("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda m: F.when(_digits(m).between(14, 19), _luhn(m)).otherwise(False)),
    "phone": Finder("phone", PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: _digits(m).between(10, 15)),
}
AT, DOT = r"\x20?[\[(](?i:at)[\])]\x20?", r"(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)"
_NO, _NOT = r"(?<![0-9A-Za-z+.,/-])", r"(?![0-9A-Za-z/-])"
#: Generators overlap each other on purpose: a number is proposed in every form that it may have, and the trees choose.
GENERATORS = {
    "spelled": Finder("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+", lambda t: t.rlike(r"[\[(](?i:at)[\])]")),
    "national": Finder("phone", rf"{_NO}(?:1[\x20.-])?(?:\([0-9]{{3}}\)[\x20-]?|[0-9]{{3}}[\x20.-])[0-9]{{3}}[\x20.-][0-9]{{4}}(?![0-9A-Za-z/])", lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    "dialled": Finder("phone", rf"{_NO}\(?0[0-9]{{1,4}}\)?(?:[\x20./-]{{1,2}}[0-9]{{2,8}}){{1,5}}{_NOT}", lambda t: t.rlike(r"0[0-9]{1,4}\)?[\x20./-]{1,2}[0-9]")),
    "groups": Finder("phone", rf"{_NO}[0-9]{{2,4}}(?:[\x20.-][0-9]{{2,4}}){{2,5}}{_NOT}", lambda t: t.rlike(r"[0-9][\x20.-][0-9]{2,4}[\x20.-][0-9]")),
    "bare": Finder("phone", rf"{_NO}[0-9]{{10,11}}{_NOT}", lambda t: t.rlike(r"[0-9]{10}")),
    "number": Finder("id", rf"{_NO}(?:[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}|[0-9]{{9,13}}){_NOT}", lambda t: t.rlike(r"[0-9]{9}|[0-9]-[0-9]{2}-[0-9]|[A-Z]{2}[0-9]{2}")),
    "ip6": Finder("ip", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])", lambda t: t.rlike(r"[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]{1,4}:")),
    "dated": Finder("birth", rf"{_NO}(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}){_NOT}", lambda t: t.rlike(r"[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]")),
}
CONTEXT = 40
PRECISION = 0.97
MODEL_ROWS = 2400
#: A candidate is at most about 130 characters long and its kind's candidates don't overlap, so rivals are near it in order.
RIVALS = 48

_WORDS = {
    "calls": r"(?i)\b(?:tel|t\xe9l|phone|call|mobile|cell|fax|dial|whatsapp|sms|telefon|tel\xe9fono|ring)\w*\W{0,6}(?:\w+\W{1,3}){0,3}$",
    "mails": r"(?i)\b(?:e-?mail|mail|write|contact|reach)\w*\W{0,6}(?:\w+\W{1,3}){0,3}$",
    "papers": r"(?i)\b(?:ssn|social security|iban|passport|account|identity|tax id|licen[cs]e)\b[^0-9]{0,14}$",
    "births": r"(?i)\b(?:born|birth|birthday|dob|geboren|n\xe9e?|nacid[ao])\b[^0-9]{0,14}$",
    "counts": r"(?i)\b(?:order|invoice|no|nr|version|isbn|issn|page|pages|serial|item|batch|total|sum|date|on|from|release|build|part)\b[^0-9]{0,8}$",
}


def features(span: Column) -> dict[str, Column]:
    """Format and context features of one candidate, as doubles. `rank` is the generator's number."""
    m, left = span["match"], span["left"]
    number = lambda c: c.cast("double")
    return {
        **{f"is_{k}": number(span["rank"] == i) for i, k in enumerate(GENERATORS)},
        "digits": number(_digits(m)),
        "length": number(F.length(m)),
        "breaks": number(F.length(F.regexp_replace(m, r"[^\x20./-]", ""))),
        "dots": number(F.length(m) - F.length(F.replace(m, F.lit("."), F.lit("")))),
        "slashes": number(F.contains(m, F.lit("/"))),
        "parens": number(F.contains(m, F.lit("("))),
        "letters": number(F.length(F.regexp_replace(m, "[^A-Za-z]", ""))),
        "dated": number(m.rlike(r"^(?:19|20)[0-9]{2}[./-]|[./-](?:19|20)[0-9]{2}$")),
        "leads": number(m.rlike(r"^\(?0|^\([0-9]{3}\)")),
        "nanp": number(m.rlike(r"^(?:1[\x20.-])?(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$")),
        "ssn": number(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "iban": number(m.rlike(r"^[A-Z]{2}[0-9]{2}")),
        **{k: number(left.rlike(p)) for k, p in _WORDS.items()},
        "unit": number(span["right"].rlike(r"^\s?(?:%|€|\$|kg|km|mb|px|th\b|st\b)")),
    }


def labelled(rows: int = MODEL_ROWS, seed: int = 11) -> list[tuple[str, int, int, str]]:
    """Made-up lines, each with one piece of personal data (start, end, kind) or one that only looks like it (kind "")."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    x = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    plain = lambda: " ".join(w() for _ in range(r.randint(1, 5))) + " "
    date = lambda: r.choice([f"{r.randint(10, 28)}.{r.randint(10, 12)}.19{d(2)}", f"19{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/19{d(2)}"])
    at, dot = (lambda: r.choice([" (at) ", "[at]", "(at)", " [AT] "])), (lambda: r.choice([" (dot) ", "[dot]", "."]))
    call = ("call ", "phone: ", "tel. ", "fax ", "mobile number ", "Tel: ", "phone me on ", "ring ")
    things = ("on ", "order ", "version ", "pages ", "total ", "from ", "item ", "serial ")
    kinds = [
        ("email", ("mail ", "contact: ", "write to "), lambda: f"{w()}.{w()}{at()}{w()}{dot()}{r.choice(['com', 'org', 'net', 'de'])}"),
        ("phone", call, lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}"])),
        ("phone", call, lambda: r.choice([f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(7)}", f"(0{d(3)}) {d(6)}"])),
        ("phone", call, lambda: d(10)),
        ("id", ("SSN ", "ssn: ", "social security "), lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        ("id", ("IBAN: ", "account "), lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"),
        ("id", ("passport number ", "account ", "tax id ", "identity "), lambda: d(r.choice((9, 12)))),
        ("ip", ("from ", "host ", "address "), lambda: r.choice([":".join(x(4) for _ in range(8)), f"{x(4)}:{x(4)}::{x(4)}"])),
        ("birth", ("born ", "date of birth: ", "DOB ", "birthday "), date),
        ("", ("meet ", "look "), lambda: f"{w()}{at()}{w()}{dot()}{d(r.randint(1, 3))}"),
        ("", things, date),
        ("", things, lambda: r.choice([f"{d(2)}-{d(2)}", f"{d(3)} {d(3)}", f"{d(2)}.{d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)}"])),
        ("", things, lambda: d(r.choice((9, 10, 12, 13)))),
        ("", ("at ", "until "), lambda: f"{r.randint(10, 23)}:{d(2)}:{d(2)}"),
    ]
    out = []
    for _ in range(rows):
        kind, lead, make = r.choice(kinds)
        m = make()
        left = plain() + (r.choice(lead) if kind in ("id", "birth") or r.random() < 0.85 else "")
        right = r.choice([" " + w(), ", " + w(), ".", "", r.choice([" kg", " %", " km"]) if not kind else " " + w()])
        out.append((left + m + right, len(left), len(left) + len(m), kind))
    return out


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """The other columns of `docs`, with `base` spans and `found`: what the generators propose that no base span overlaps, by start."""
    others = [c for c in docs.columns if c != text]
    found = with_spans(docs, text, BASE | GENERATORS, CONTEXT)
    ranked = lambda k, i: F.transform(F.col(k), lambda s: s.withField("rank", F.lit(i)))
    gathered = found.select(*others, F.concat(*BASE).alias("base"), F.concat(*[ranked(k, i) for i, k in enumerate(GENERATORS)]).alias("found"))
    free = F.filter("found", lambda s: overlaps_none(s, F.col("base")))
    return gathered.select(*others, "base", F.array_sort(free).alias("found"))


def _with_features(found: Column) -> Column:
    """Features are computed once for a candidate, however many splits of the trees ask for them."""
    return F.transform(found, lambda s: F.struct(s.alias("s"), F.struct(*[c.alias(n) for n, c in features(s).items()]).alias("f")))


@lru_cache(maxsize=4)
def _fitted(application: str, rows: int, precision: float) -> tuple[boosting.Model, dict[int, float]]:
    spark = SparkSession.getActiveSession()
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"text": t, "a": a, "b": b, "kind": k} for t, a, b, k in labelled(rows)])), "array<struct<text:string,a:bigint,b:bigint,kind:string>>")).alias("x")).select("x.*")
    seen = candidates(made, "text").select("a", "b", "kind", F.explode(_with_features(F.col("found"))).alias("c"))
    right = (F.col("c.s.start") == F.col("a")) & (F.col("c.s.end") == F.col("b")) & (F.col("c.s.kind") == F.col("kind"))
    got = seen.select(right.cast("int").alias("label"), F.col("c.s.rank").alias("rank"), "c.f.*").collect()
    names = list(features(F.struct(*[F.lit(None).alias(n) for n in ("rank", "match", "left", "right")])))
    x, y, rank = np.array([[r[k] for k in names] for r in got]), np.array([r["label"] for r in got]), np.array([r["rank"] for r in got])
    model, rest = boosting.fit(x, y, names, trees=40)
    p = model.probability(x)
    return model, {k: boosting.threshold(p[own], y[own], precision) if len(own) else 0.99 for k in range(len(GENERATORS)) for own in [rest[rank[rest] == k]]}


def fitted(spark: SparkSession, rows: int = MODEL_ROWS, precision: float = PRECISION) -> tuple[boosting.Model, dict[int, float]]:
    """The trees and the threshold of each generator, fitted once for an application on the candidates in `rows` made-up lines."""
    return _fitted(spark.sparkContext.applicationId, rows, precision)


def find(docs: DataFrame, text: str = "text", rows: int = MODEL_ROWS, precision: float = PRECISION) -> DataFrame:
    """(row: struct of all columns but `text`, base, added): arrays of spans (start, rank, kind, end, match, left, right).

    Added spans overlap no base span. Of added spans that overlap each other the most probable one is reported, of equally
    probable ones the longer, then the earlier one, then the one of the earlier generator.
    """
    model, least = fitted(docs.sparkSession, rows, precision)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("__none"))
    seen = candidates(docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("__text")), "__text").select("row", "base", _with_features(F.col("found")).alias("c"))
    scored = seen.select("row", "base", F.expr(f"transform(c, x -> struct(x.s AS s, {model.sql('x.f.')} AS p))").alias("c"))
    sure = scored.select("row", "base", F.filter("c", lambda x: x["p"] >= F.get(F.array(*[F.lit(least[i]) for i in range(len(GENERATORS))]), x["s"]["rank"])).alias("c"))

    def beats(y: Column, x: Column) -> Column:
        a, b = y["s"], x["s"]
        longer, equal = a["end"] - a["start"] > b["end"] - b["start"], a["end"] - a["start"] == b["end"] - b["start"]
        first = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"]))
        return (a["start"] < b["end"]) & (b["start"] < a["end"]) & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & (longer | (equal & first))))

    near = lambda i: F.slice(F.col("c"), F.greatest(i - RIVALS, F.lit(0)) + 1, F.lit(2 * RIVALS + 1))
    best = F.filter("c", lambda x, i: ~F.exists(near(i), lambda y: beats(y, x)))
    return sure.select("row", "base", F.transform(best, lambda x: x["s"].withField("rank", x["s"]["rank"] + len(BASE))).alias("added"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every reported span replaced by its kind in brackets."""
    whole = docs.withColumn("__whole", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    spans = find(whole, text).withColumnRenamed("row", "__row")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    full = F.col("__row.__whole")
    # Pieces between spans, then one join: a text of many spans isn't copied for each of them.
    reach = F.col("reach")
    held = spans.select("__row", ordered.alias("o")).select("__row", "o", F.transform("o", lambda s, i: F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.array_max(F.transform(F.slice(F.col("o"), F.greatest(i - RIVALS, F.lit(0)) + 1, F.least(i, F.lit(RIVALS))), lambda t: t["end"])), F.lit(0).cast("bigint")))).alias("reach"))
    piece = lambda s, i: F.when(s["start"] < F.get(reach, i), F.lit("")).otherwise(F.concat(F.substring(full, F.get(reach, i).cast("int") + 1, (s["start"] - F.get(reach, i)).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.coalesce(F.array_max(F.transform("o", lambda s: s["end"])), F.lit(0).cast("bigint"))
    out = F.concat(F.array_join(F.transform("o", piece), ""), F.substring(full, last.cast("int") + 1, F.length(full)))
    return held.select(*[out.alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table with doc_id and text."""
    found = find(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
