"""Benchmark decontamination by a distributed positional inverted index.

1. Training tokens become postings (term, row, position), stored in the shared folder. Terms that no benchmark window has can
   never take part in a match, so they have no postings; documents are read and cut into words once.
2. Terms are counted over the stored postings, and the terms of each window are put in order of rarity.
3. A window's lists are intersected from its rarest term on. A posting at position p of a term at offset o says that the
   window may start at p - o: the rarest list gives the candidates (row, start), and the next list keeps those that it has
   at start + o. The few that are left are held against the lists of all other terms.

A list is met by equality of row, term and position, which no two postings share, so a frequent term is dealt out like any
other; nothing is grouped by term but partial counts.

Proximity matches need `least` of a window's distinct terms near one place. A place with so many has one of the window's
(terms - least + 1) rarest, so postings of these propose all places; terms that no document has count among the rarest.

Broadcasts have a counted bound: terms, windows and rows of candidates, with at most BROADCAST_ROWS rows each. A larger
windows table is joined by shuffling postings by term and a salt, a larger set of rows by shuffling postings by row.

Defined results: null and empty texts have no words; null item ids count as an empty string; repeated rows are rows of
their own; no items or no documents give no hits or no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, ascii_lower, cut, small, stored, words_of

WINDOW = 10
BROADCAST_ROWS = 200_000
#: So many lists are intersected one by one; the candidates that are left are held against all others at once.
LISTS, SALTS = 2, 32


def plain_words(text: Column) -> Column:
    return words_of(ascii_lower(text), PLAIN_WORD)


def windows(items: DataFrame, item_col: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(window: array<string>, items: sorted distinct ids as strings) for all windows of all items."""
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), plain_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    every = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("window"))
    return every.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _counted(table: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(term, n): how often each term of the windows is in the documents; terms that no document has are missing."""
    terms = table.select(F.explode("window").alias("term")).distinct()
    terms = F.broadcast(terms) if small(terms, BROADCAST_ROWS) else terms
    return docs.select(F.explode(plain_words(F.col(text))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def proposing(table: DataFrame, docs: DataFrame, least: int, text: str = "text") -> DataFrame:
    """(anchor, words, windows: array of struct(window, items)): windows by rarest terms, one of which is wherever `least` of a window's distinct terms are.

    Windows of one item that share a term are one row, so that a posting that has few of all their `words` around it is done with.
    """
    placed = table.select("window", "items", F.explode(F.array_distinct("window")).alias("term")).join(_counted(table, docs, text), "term", "left")
    ranked = placed.groupBy("window").agg(F.first("items").alias("items"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("t"))
    rarest = ranked.select("window", "items", F.explode(F.slice("t", F.lit(1), F.greatest(F.size("t") - least + 1, F.lit(0)))).alias("x"))
    grouped = rarest.filter("x.n > 0").groupBy(F.col("x.term").alias("anchor"), F.col("items")[0]).agg(F.collect_list(F.struct("window", "items")).alias("windows"))
    return grouped.select("anchor", F.array_distinct(F.flatten("windows.window")).alias("words"), "windows")


def _postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """All postings, and one of the empty term for each document, which carries the document itself."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.concat(F.array(F.lit("")), plain_words(F.col(text))).alias("w"))
    return rows.select("row", "id", "w", F.posexplode("w").alias("p", "term"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, n_words, t, p), stored: every position of a term of `terms` (term, t), and for each row itself a posting of t = -1."""
    itself = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("bigint").alias("t"))
    known = terms.select("term", "t").unionByName(itself)
    known = F.broadcast(known) if small(terms, BROADCAST_ROWS) else known
    words = F.concat(F.array(F.lit("")), plain_words(F.col(text)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("w"))
    every = rows.select("row", "id", (F.size("w") - 1).alias("n_words"), F.posexplode("w").alias("p", "term"))
    return stored(every.join(known, "term").select("row", "id", "n_words", "t", (F.col("p") - 1).alias("p")), "postings")


def ranked(table: DataFrame, terms: DataFrame, posts: DataFrame) -> DataFrame:
    """(wid, size, r): the terms of each window (wid, window) as structs of (n, t, o), rarest first; a window with a term that no row has is gone."""
    # A frequent term has a partial count in every partition; these come together in two steps, first by parts of the row ids.
    parts = posts.groupBy("t", F.pmod(F.shiftright("row", 33), F.lit(SALTS)).alias("part")).agg(F.count("*").alias("n"))
    counts = parts.groupBy("t").agg(F.sum("n").alias("n"))
    placed = table.select("wid", F.size("window").alias("size"), F.posexplode("window").alias("o", "term")).join(terms, "term").join(counts, "t")
    per = placed.groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("n", "t", "o"))).alias("r"))
    return per.filter(F.size("r") == F.col("size"))


def _listed(posts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Postings of the terms in `wanted` (t, ...), with its other columns; `size` bounds what may be broadcast."""
    if small(wanted, size):
        return posts.join(F.broadcast(wanted), "t")
    spread = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return posts.withColumn("__salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, ["t", "__salt"]).drop("__salt")


def intersected(posts: DataFrame, lists: DataFrame) -> DataFrame:
    """(row, wid, start, size) of every place where all terms of a window stand at their offsets. `lists`: see `ranked`."""
    at = lambda k: F.col("r")[k]
    key = ["row", "t", "p"]
    first = lists.select("wid", "size", "r", at(0)["t"].alias("t"), at(0)["o"].alias("o"))
    start = F.col("p") - F.col("o")
    found = _listed(posts, first, BROADCAST_ROWS).select("row", "wid", "size", "r", start.alias("start"), "n_words")
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))).drop("n_words")
    for k in range(1, LISTS):
        own = _listed(posts.select(*key), lists.filter(F.col("size") > k).select(at(k)["t"].alias("t")).distinct(), BROADCAST_ROWS)
        met = found.filter(F.col("size") > k).select("*", at(k)["t"].alias("t"), (F.col("start") + at(k)["o"]).alias("p")).join(own, key, "left_semi").drop("t", "p")
        found = found.filter(F.col("size") <= k).unionByName(met)
    found = cut(found)
    rows = found.filter(F.col("size") > LISTS).select("row").distinct()
    near = posts.select(*key).join(F.broadcast(rows) if small(rows, BROADCAST_ROWS) else rows, "row", "left_semi")
    rest = found.filter(F.col("size") > LISTS).select("row", "wid", "start", "size", F.explode(F.slice("r", F.lit(LISTS + 1), F.col("size"))).alias("x"))
    rest = rest.select("row", "wid", "start", "size", F.col("x.t").alias("t"), (F.col("start") + F.col("x.o")).alias("p")).join(near, key)
    whole_ = rest.groupBy("row", "wid", "start", "size").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("size") - LISTS).drop("n")
    return found.filter(F.col("size") <= LISTS).select("row", "wid", "start", "size").unionByName(whole_)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((row, id, n_words) of every row; (row, start, length, items) of every place where a window occurs)."""
    table = cut(windows(items, text="text", width=width).withColumn("wid", F.monotonically_increasing_id()))
    terms = cut(table.select(F.explode("window").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()))
    posts = postings(docs, terms, id_col, text)
    found = intersected(posts.filter("t >= 0"), cut(ranked(table, terms, posts)))
    named = table.select("wid", "items")
    named = F.broadcast(named) if small(named, BROADCAST_ROWS) else named
    return posts.filter("t < 0").select("row", "id", F.col("n_words").cast("bigint").alias("n_words")), found.join(named, "wid").select("row", "start", F.col("size").alias("length"), "items")


def _near(docs: DataFrame, items: DataFrame, id_col: str, text: str, width: int, slop: int, least: int) -> DataFrame:
    """(row, id, items, start, terms) for every document and window with at least `least` distinct terms near one place."""
    table = cut(proposing(cut(windows(items, text="text", width=width)), docs, least, text))
    # Around a posting lie all words of the places that it can belong to, each with `slop` words on either side.
    low = F.greatest(F.col("p") - (width - 1) - 2 * slop, F.lit(1))
    near = F.slice("w", low + 1, F.col("p") - low + width + 2 * slop)
    common = lambda words, of: F.size(F.array_intersect(words, of))
    posts = _postings(docs, id_col, text)
    if small(table, BROADCAST_ROWS):
        fits = common(near, F.col("words")) >= least
        met = posts.join(F.broadcast(table), (F.col("term") == F.col("anchor")) & fits).select("row", "id", "p", "windows", low.alias("low"), near.alias("near"))
    else:
        posts = posts.select("row", "id", "p", "term", low.alias("low"), near.alias("near"))
        met = posts.join(table, (F.col("term") == F.col("anchor")) & (common(F.col("near"), F.col("words")) >= least)).select("row", "id", "p", "windows", "low", "near")
    met = met.select("row", "id", "p", "low", "near", F.explode("windows").alias("x")).select("row", "id", "p", "low", "near", "x.window", "x.items")
    met = met.filter(common(F.col("near"), F.col("window")) >= least)
    size = F.size("window")

    def place(s: Column) -> Column:
        first = F.greatest(s - slop, F.col("low"))
        return F.struct(common(F.slice("near", first - F.col("low") + 1, s + size + slop - first), F.col("window")).alias("terms"), (-s).alias("back"))

    best = F.array_max(F.transform(F.sequence(F.col("p") - size + 1 - slop, F.col("p") + slop), place))
    found = met.select("row", "id", "window", "items", best.alias("best")).filter(F.col("best.terms") >= least)
    per = found.groupBy("row", "window").agg(F.first("id").alias("id"), F.first("items").alias("items"), F.max("best").alias("best"))
    return per.select("row", "id", "items", (-F.col("best.back")).alias("start"), F.col("best.terms").alias("terms"))


def proximity(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WINDOW, slop: int = 5, least: int = 8) -> DataFrame:
    """(id, items, start, terms): for every document and window the place at which most of the window's distinct terms, `least` or more, lie within `slop` words.

    Of equal places it is the first; one before a document's first word is 0 or less. Windows of fewer distinct terms have none.
    """
    return _near(docs, items, id_col, text, width, slop, least).select("id", "items", "start", "terms")


def near_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_windows, most_terms, n_items, items_sha256) for the documents with proximity matches; `report` has the exact ones."""
    met = _near(docs.select("doc_id", "text"), items.select("item_id", "text"), "doc_id", "text", WINDOW, 5, 8)
    per = met.groupBy("row").agg(F.first("id").alias("doc_id"), F.count("*").alias("n_windows"), F.max("terms").cast("bigint").alias("most_terms"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    return per.select("doc_id", "n_windows", "most_terms", F.size("found").cast("bigint").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns for documents (doc_id, text) and items (item_id, text)."""
    rows, found = matches(docs.select("doc_id", "text"), items.select("item_id", "text"))
    per = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
        ),
        lambda a: a["n"].cast("bigint"),
    )
    hit = per.select("row", covered.alias("n_hit"), F.size("found").cast("bigint").alias("n_items"), F.array_join("found", ",").alias("joined"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = rows.join(hit, "row", "left").select(F.col("id").alias("doc_id"), "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` (with doc_id and text) in which no window occurs; repeated rows go or stay together."""
    keyed = docs.select(F.struct("*").alias("__row"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("__key"))
    rows, found = matches(keyed.select(F.col("__key").alias("doc_id"), F.col("__row.text").alias("text")), items.select("item_id", "text"))
    hit = rows.join(found.select("row").distinct(), "row").select(F.col("id").alias("__key")).distinct()
    return keyed.join(hit, "__key", "left_anti").select("__row.*")
