"""License scans by diagonal voting.

Rolling word k-gram hashes of all documents are joined with the positions of the same k-grams in license templates; a hit
counts only if the first and the last word of both k-grams are the same, so a span's words are compared and not its hashes
alone. A template that stands in a document gives many hits with the same difference of positions, its diagonal: hits are
counted for each diagonal (partially before the shuffle), neighbouring diagonals are merged, as an inserted or missing word
moves the rest of a template to the next one, and a span is reported if enough of the template stands there.

The template table is fixed (a few thousand k-grams), so it is broadcast. One shuffle has a row for each document and
diagonal with votes, a second one a row for each document; nothing else leaves its partition. Diagonals are merged by a
window over a document's diagonals of one template, so a text is linear work however often a template stands in it.

Defined results: null and empty texts have no words and no labels; repeated rows are rows of their own; an empty table
gives an empty result; columns other than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, whole
from .decontaminate import plain_words

K = 4
#: Diagonals up to so many words apart are merged.
NEIGHBOURS = 4
#: Share of a template's k-grams that must stand in a merged span; short templates must stand whole.
LEAST_SHARE, SHORT_WORDS, SHORT_SHARE = 0.5, 14, 1.0
#: The contract's phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Bodies, opening passages and notices of public licenses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
)


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, grams, words, tpos, gram, tfirst, tlast): the positions of all k-grams of all templates, with their first and last word."""
    rows = []
    for i, (label, text) in enumerate(texts):
        w = text.split(" ")
        rows.append(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(len(w) - k + 1).alias("grams"), F.lit(len(w)).alias("words"), F.array(*[F.lit(x) for x in w]).alias("w")))
    every = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    grams = _grams(F.col("w"), k)
    placed = every.select("template", "label", "grams", "words", "w", F.posexplode(grams).alias("tpos", "gram"))
    return placed.select("template", "label", "grams", "words", "tpos", "gram", F.get("w", F.col("tpos")).alias("tfirst"), F.get("w", F.col("tpos") + (k - 1)).alias("tlast"))


def _grams(w: Column, k: int) -> Column:
    """64-bit hashes of all k-grams of an array of words."""
    return F.when(F.size(w) >= k, F.transform(F.slice(w, 1, F.size(w) - (k - 1)), lambda x, i: F.xxhash64(x, *[w[i + j] for j in range(1, k)]))).otherwise(F.array().cast("array<bigint>"))


def base_places(w: Column, low: Column) -> Column:
    """struct(start, label) of every place where a base phrase stands, for words `w` of the lower-cased text `low`."""

    def at(i: Column, word: Column) -> Column:
        cases = None
        for phrase, label in PHRASES.items():
            p = phrase.split(" ")
            hit = word == p[0]
            for j in range(1, len(p)):
                hit = hit & F.coalesce(F.get(w, i + j) == p[j], F.lit(False))
            cases = F.when(hit, label) if cases is None else cases.when(hit, label)
        return cases

    starts = sorted({p.split(" ")[0] for p in PHRASES})
    lasts = {p.split(" ")[-1] for p in PHRASES}
    possible = F.lit(False)
    for last in sorted(lasts):
        possible = possible | F.contains(low, F.lit(last))
    first = F.lit(False)
    for s in starts:
        first = first | F.contains(low, F.lit(s))
    places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(starts), F.struct(i.alias("start"), at(i, x).alias("label")))), lambda s: s["label"].isNotNull())
    return F.when(possible & first, places).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(id, n_words, base, spans) for every row: base places, and verified spans (template, label, start, end, share)."""
    spark = docs.sparkSession
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("t"), plain_words(F.col(text)).alias("w"))
    rows = words.select("row", "id", F.size("w").cast("bigint").alias("n_words"), base_places(F.col("w"), ascii_lower(whole(F.col("t")))).alias("base"), "w", _grams(F.col("w"), k).alias("g"))
    # Each k-gram goes with its first and last word; the null k-gram at place -1 stands for the document itself.
    itself = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("bigint").alias("gram"), F.lit("").alias("first"), F.lit("").alias("last")))
    placed = F.transform("g", lambda x, i: F.struct(i.alias("p"), x.alias("gram"), F.get("w", i).alias("first"), F.get("w", i + (k - 1)).alias("last")))
    grams = rows.select("row", "id", "n_words", "base", F.explode(F.concat(itself, placed)).alias("x")).select("row", "id", "n_words", "base", "x.*")
    nothing = [F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("grams"), F.lit(0).alias("words"), F.lit(-1).alias("tpos"), F.lit(None).cast("bigint").alias("known"), F.lit("").alias("tfirst"), F.lit("").alias("tlast")]
    known = F.broadcast(templates(spark, k=k).withColumnRenamed("gram", "known").unionByName(spark.range(1).select(*nothing)))
    hits = grams.join(known, F.col("gram").eqNullSafe(F.col("known")) & (F.col("first") == F.col("tfirst")) & (F.col("last") == F.col("tlast")))
    votes = hits.groupBy("row", "template", (F.col("p") - F.col("tpos")).alias("diagonal")).agg(
        F.first(F.when(F.col("template") < 0, F.struct("id", "n_words", "base"))).alias("doc"),
        F.first("label").alias("label"),
        F.first("grams").alias("grams"),
        F.first("words").alias("words"),
        F.count("*").alias("votes"),
        F.min("p").alias("low"),
        (F.max("p") + (k - 1)).alias("high"),
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    broken = votes.withColumn("break", F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEIGHBOURS, 0).otherwise(1))
    merged = broken.withColumn("run", F.sum("break").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "template", "run").agg(
        F.first("doc").alias("doc"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.first("words").alias("words"), F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal")
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    least = F.when(F.col("words") < SHORT_WORDS, SHORT_SHARE).otherwise(LEAST_SHARE)
    sure = (F.col("template") >= 0) & (share >= least) & (F.col("high") - F.col("low") <= 2 * F.col("words"))
    span = F.struct("template", "diagonal", "label", F.col("low").alias("start"), F.col("high").alias("end"), share.alias("share"))
    per = merged.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_sort(F.collect_list(F.when(sure, span))).alias("spans"))
    slim = F.transform("spans", lambda s: F.struct(s["template"].alias("template"), s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["share"].alias("share")))
    return per.select("doc.id", "doc.n_words", "doc.base", slim.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table with doc_id and text."""
    out = scanned(docs.select("doc_id", "text"))
    places, labels = F.transform("base", lambda s: s["start"]), F.transform("base", lambda s: s["label"])
    put = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        put(labels).alias("base_labels"),
        put(F.concat(labels, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )
