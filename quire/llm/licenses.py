"""License scan by diagonal voting, in DataFrame operations only.

Each text's words are turned into rolling hashes of 2 and of 4 words, and all
of them are joined to the positions of the templates' word runs. A hit at word
p of the text and word q of a template votes for the diagonal p - q, where the
template would start. Votes are gathered by diagonal, neighbouring diagonals of
a long template (words were added or left out) are merged, and the span is
verified: words that hash alike must be equal, a place of the template counts
once however often its words recur, and only places that follow each other in
the text as they do in the template count.

The base templates are short phrases, found by runs of 2 words: a place counts
only if every run of the phrase votes for it. The long templates are whole
texts of short licenses and the opening passages or notices of well-known ones;
they use runs of 4 words and add labels.

The join's first half is done where the hashes are: the template hashes (a
constant of some thousand numbers) are a set that the array of a text's hashes
is filtered by, so only runs that join leave the array, each with its own few
words; a text's cost is linear in its length. The template table is broadcast.
Each text carries one extra hash that always joins, so texts without a hit stay,
and the texts are read once. Everything after the join is keyed by the row,
which no source or host can make hot.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows each give a
row. Texts of fewer than two words have no base place. An empty table gives no
rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import documents

#: The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Passages of published licenses, and the labels they add.
PASSAGES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
]
#: Whole texts of short published licenses, and the labels they add.
TEXTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
     "the software or the use or other dealings in the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
     "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
     "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
     "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
     "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
     "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
     "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
     "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
     "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
     "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
     "would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
     "this notice may not be removed or altered from any source distribution", "zlib"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
     "or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all "
     "copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
     "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law", "unlicense"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT, LONG = 2, 4
GAP = 8
COVER = 0.6
_ALWAYS = -1


def words_of(text: F.Column) -> F.Column:
    """The words of a text: A-Z lower-cased, split at ASCII that is no digit or letter.

    Other letters are folded with them, which is faster and changes no result:
    words are counted and compared with ASCII words only, and the one letter
    that folding would turn into ASCII, the Kelvin sign, is kept from it.
    """
    folded = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.array_remove(F.split(folded, SEPARATORS, -1), "")


def _pair(a, b):
    return F.xxhash64(a, b)


def _four(a, b):
    return F.xxhash64(F.lit(LONG), a, b)


def template_table(spark: SparkSession, phrases=None, passages=None) -> DataFrame:
    """A row for each run of words of each template: h, template, label, base, k, tpos, gram, n_grams."""
    rows = []
    named = [(p, label, True, SHORT) for p, label in (PHRASES if phrases is None else phrases)]
    named += [(p, label, False, LONG) for p, label in (PASSAGES + TEXTS if passages is None else passages)]
    for number, (passage, label, base, k) in enumerate(named):
        words = re.findall(r"\w+", passage)
        n = len(words) - k + 1
        rows += [(number, label, base, k, at, words[at : at + k], n) for at in range(n)]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, k int, tpos int, gram array<string>, n_grams int")
    g = F.col("gram")
    h = F.when(F.col("k") == SHORT, _pair(g[0], g[1])).otherwise(_four(_pair(g[0], g[1]), _pair(F.get(g, F.lit(2)), F.get(g, F.lit(3)))))
    always = spark.range(1).select(
        F.lit(_ALWAYS).cast("long").alias("h"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"),
        F.lit(0).alias("k"), F.lit(0).alias("tpos"), F.array().cast("array<string>").alias("gram"), F.lit(1).alias("n_grams"),
    )
    return grams.select(h.alias("h"), "template", "label", "base", "k", "tpos", "gram", "n_grams").union(always)


def _joining(hashes: str, known: list[int], k: int):
    """Of an array of rolling hashes those that are in a template: (hash, place, the run's words)."""
    own = lambda at: F.array(*(F.get("words", at + j) for j in range(k)))  # noqa: E731  (slice would copy all words for each run)
    run = lambda h, at: F.when(h.isin(known), F.struct(h.alias("h"), at.alias("at"), own(at).alias("own")))
    return F.filter(F.transform(hashes, run), lambda x: x.isNotNull())


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """All runs of all texts that stand in a template, with the row's own hit first: row, doc_id, n_words, template, label, base, n_grams, diagonal, tpos."""
    known = {k: [r.h for r in templates.where(F.col("k") == k).select("h").distinct().collect()] for k in (SHORT, LONG)}
    n = F.size("words")
    start = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", n)
    pairs = start.withColumn(
        "pairs", F.zip_with(F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), _pair)
    )
    m = F.greatest(F.size("pairs") - 2, F.lit(0))
    fours = pairs.withColumn("fours", F.zip_with(F.slice("pairs", F.lit(1), m), F.slice("pairs", F.lit(3), m), _four))
    own = F.struct(F.lit(_ALWAYS).cast("long").alias("h"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("own"))
    found = F.concat(_joining("pairs", known[SHORT], SHORT), _joining("fours", known[LONG], LONG), F.array(own))
    # no array but the hits' own words goes past the explode
    runs = fours.select("row", "doc_id", "n_words", found.alias("found")).select("row", "doc_id", "n_words", F.explode("found").alias("r")).select("row", "doc_id", "n_words", "r.*")
    return (
        runs.join(F.broadcast(templates), "h")
        .where(F.col("own") == F.col("gram"))
        .select("row", "doc_id", "n_words", "template", "label", "base", "n_grams", (F.col("at") - F.col("tpos")).alias("diagonal"), "tpos")
    )


def _chain(spots):
    """The longest run of hits, in the order of the text, whose template places rise: kept is the smallest last place of a run of each length."""
    put = lambda kept, q: F.concat(F.filter(kept, lambda x: x < q), F.array(q), F.slice(kept, F.size(F.filter(kept, lambda x: x < q)) + 2, F.greatest(F.size(kept), F.lit(1))))
    return F.aggregate(F.array_sort(spots), F.array().cast("array<int>"), lambda kept, x: put(kept, -x["back"]), F.size)


def spans(found: DataFrame, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Votes by diagonal, neighbouring diagonals of long templates merged, and spans verified: adds votes, first, last (diagonals).

    votes are distinct places of the template; in a span of which enough are
    there they are those that stand in the template's order.
    """
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "n_grams"]
    votes = found.repartition("row").groupBy(*keys, "diagonal").agg(F.collect_set("tpos").alias("seen"))
    order = Window.partitionBy(*keys).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    new = F.when(step.isNull() | F.col("base") | (step > gap), 1).otherwise(0)
    merged = votes.withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spots = F.transform("seen", lambda q: F.struct((F.col("diagonal") + q).alias("at"), (-q).alias("back")))
    whole = merged.groupBy(*keys, "span").agg(
        F.flatten(F.collect_list(spots)).alias("spots"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last")
    )
    places = F.size(F.array_distinct(F.transform("spots", lambda x: x["back"])))
    aligned = F.when(F.col("base") | (F.col("template") < 0) | (places < cover * F.col("n_grams")), places).otherwise(_chain(F.col("spots")))
    return whole.select(*keys, "span", aligned.cast("long").alias("votes"), "first", "last")


def scan(docs: DataFrame, templates: DataFrame | None = None, cover: float = COVER) -> DataFrame:
    """One row for each text: n_words, base places and labels, all labels, and the best span's share of its template."""
    templates = template_table(docs.sparkSession) if templates is None else templates
    share = F.col("votes") / F.col("n_grams")
    real = F.col("template") >= 0
    base = F.col("base") & (F.col("votes") == F.col("n_grams"))
    any_label = base | ~F.col("base") & real & (share >= cover)
    joined = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans(hits(docs, templates), cover=cover).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(any_label).alias("labels"),
        F.coalesce(F.max(F.when(any_label, share)), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
