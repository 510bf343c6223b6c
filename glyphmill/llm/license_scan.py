"""License scans: exact set-similarity join of text blocks with license templates. DataFrame functions only.

A text is one sequence of words; line breaks part words as any symbol does. For each template there is a reach, the least
power of two (8 at least) that its words fit in, and blocks are windows of twice the reach at every reach.
So any passage of up to as many words as the reach, and one more, lies whole in some block, wherever lines are wrapped.
A template meets a block that holds ``THRESHOLD`` of its distinct words. Template words are put in one global
order, that of the number of documents that hold them, rarest first. If a block holds enough of a template's n words, it
holds one of the n - need + 1 rarest (prefix filter), has ``need`` words at least (length filter), and from the
rarest shared word on, both sides have enough words left (positional filter). What passes is
verified on the full sets, so the join is exact.

A text is scanned once. Only texts that hold enough words of some template are cut into blocks, and only
blocks around a prefix word are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Phrases and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Texts of license notices, words in lower case, and the labels they give.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
    " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
    " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-3-clause": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce"
    " the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright"
    " holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"
    " of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
    " merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form"
    " or as a compiled binary for any purpose commercial or non commercial and by any means",
}
THRESHOLD = 0.9
LEAST_REACH = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def need(n: int) -> int:
    """Words that a block must share with a template of ``n`` distinct ones."""
    return math.ceil(THRESHOLD * n - 1e-9)


def reach(template: str) -> int:
    return max(LEAST_REACH, 1 << (len(template.split()) - 1).bit_length())


def _words(text: Column) -> Column:
    """' w0 w1 ... ' with A-Z in lower case, ' ' without words."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), SEPARATORS, " ")


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def base_columns(words: Column) -> dict[str, Column]:
    any_phrase = " (?:" + "|".join(PHRASES) + ")(?= )"
    count = F.regexp_count(words, F.lit(any_phrase)).cast("long")
    return {
        "n_words": F.greatest(_spaces(words) - 1, F.lit(0)),
        "n_base": count,
        "first_word": F.when(count > 0, _spaces(F.regexp_extract(words, f"(?s)^(.*?){any_phrase}", 1))),
        "last_word": F.when(count > 0, _spaces(F.regexp_extract(words, f"(?s)^(.*){any_phrase}", 1))),
        "base": F.filter(F.array(*(F.when(F.contains(words, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items())), lambda x: x.isNotNull()),
    }


def _one_of(words: list[str]) -> str:
    """Pattern of a space and one whole word of a list, which is looked up by its first letter."""
    first = sorted({w[0] for w in words})
    return " (" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in first) + ")(?= )"


def _stretches(words: Column, rare: list[str], reach: int) -> Column:
    """ARRAY<STRUCT<reach, at>>: for each word of a list, how many whole reaches stand before it."""
    places = F.filter(F.transform(words, lambda x, i: F.when(x.isin(rare), i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: F.struct(F.lit(reach).alias("reach"), F.floor(i / reach).cast("int").alias("at")))


def word_order(known: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words in the global order; the counts have a row per template word at most."""
    counted = known.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n = {r["w"]: r["n"] for r in counted}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: (``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks).

    Null and empty texts have no words and no labels, and score 0. A base phrase scores 1, a
    block its share of the template's words. Several templates may meet a block, and all of them count. Texts are read
    whole, however long. Repeated rows give repeated rows; a null id is kept;
    other columns are not read; an empty table gives an empty one.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "license")
    sets = {label: sorted(set(t.split())) for label, t in TEMPLATES.items()}
    vocabulary = sorted(set().union(*sets.values()))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), _words(text).alias("words"))
    # template words of each text, each once; of a space between two words either may take it
    known = F.array_distinct(F.regexp_extract_all("words", F.lit(_one_of(vocabulary)), F.lit(1)))
    base = base.select("id", "h", "words", known.alias("known"), *(c.alias(k) for k, c in base_columns(F.col("words")).items()))
    enough = F.lit(False)
    for words in sets.values():
        enough |= F.size(F.array_intersect("known", F.array(*map(F.lit, words)))) >= need(len(words))
    # the one pass over the texts; words stay with the texts that may hold a template
    left = scratch.cut(base.withColumn("words", F.when(enough, F.col("words"))))
    order = word_order(left, vocabulary)
    place = {w: i for i, w in enumerate(order)}
    prefix = []
    for label, words in sets.items():
        words, n = sorted(words, key=place.__getitem__), need(len(words))
        prefix += [(w, label, words, n, i, reach(TEMPLATES[label])) for i, w in enumerate(words[: len(words) - n + 1])]
    index = spark.createDataFrame(prefix, "word string, label string, t_words array<string>, need int, pos int, reach int")
    reaches = sorted({p[5] for p in prefix})

    # windows of each reach around prefix words
    rare = {r: sorted({p[0] for p in prefix if p[5] == r}) for r in reaches}
    some = left.filter("words IS NOT NULL").select("id", "h", F.split(F.trim("words"), " ").alias("w"))
    hits = F.flatten(F.array(*(_stretches(F.col("w"), rare[r], r) for r in reaches)))
    # a place lies in the window that begins in its stretch, and in the one before
    at = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x, F.struct(x["reach"].alias("reach"), F.greatest(x["at"] - 1, F.lit(0)).alias("at"))))))
    blocks = some.select("id", "h", "w", F.explode(at).alias("b")).select("id", "h", "b.reach", "b.at", F.array_distinct(F.slice("w", F.col("b.at") * F.col("b.reach") + 1, 2 * F.col("b.reach"))).alias("set"))
    # the block's template words in global order; only these can be shared
    blocks = blocks.select("id", "h", "reach", "at", F.array_intersect(F.array(*map(F.lit, order)), F.col("set")).alias("known"), F.size("set").alias("n"))
    tokens = blocks.select("id", "h", "reach", "at", "known", "n", F.posexplode("known").alias("b_pos", "word"))
    # index: one row per prefix word of the fixed templates, a few dozen
    pairs = tokens.join(F.broadcast(index), ["word", "reach"]).filter((F.col("n") >= F.col("need")) & (F.least(F.size("t_words") - F.col("pos"), F.size("known") - F.col("b_pos")) >= F.col("need") - F.least("pos", "b_pos")))
    shared = F.size(F.array_intersect("known", "t_words"))
    met = pairs.withColumn("shared", shared).filter(F.col("shared") >= F.col("need")).select("id", "h", "reach", "at", "label", (F.col("shared") / F.size("t_words")).alias("part"))
    found = met.groupBy("id", "h").agg(F.collect_set("label").alias("more"), F.max("part").alias("part"), F.count_distinct("reach", "at").alias("blocks")).select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), "more", "part", "blocks")

    # only the rows that were cut into blocks are joined with what these met
    cut = left.filter("words IS NOT NULL").drop("words", "known").join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left").drop("f_id", "f_h")
    rest = left.filter("words IS NULL").drop("words", "known").select("*", F.lit(None).cast("array<string>").alias("more"), F.lit(None).cast("double").alias("part"), F.lit(None).cast("long").alias("blocks"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return rest.unionByName(cut).select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("part", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` of documents: its docstring says what becomes of odd rows."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = ", ".join(f"('{k}', {sorted(set(t.split()))}, {need(len(set(t.split())))}, {reach(t)})" for k, t in TEMPLATES.items())
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS w FROM documents),
ph(p, label) AS (VALUES {phrases}),
place AS (SELECT row_no, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS a0 FROM d, ph),
b AS (SELECT row_no, count(*) AS n_base, min(a0) AS first_word, max(a0) AS last_word, list_distinct(list(label)) AS base FROM place GROUP BY row_no),
t(label, words, need, reach) AS (VALUES {quoted}),
bl AS (SELECT row_no, reach, a0, list_distinct(w[a0 * reach + 1 : a0 * reach + 2 * reach]) AS s FROM (SELECT row_no, w, reach, unnest(range(0, len(w) // reach + 1)) AS a0 FROM d, (SELECT DISTINCT reach FROM t))),
met AS (SELECT row_no, reach, a0, label, len(list_intersect(s, words)) AS shared, len(words) AS size, need FROM bl JOIN t USING (reach) WHERE len(s) >= need),
m AS (SELECT row_no, list(DISTINCT label) AS more, max(CAST(shared AS DOUBLE) / size) AS part, count(DISTINCT (reach, a0)) AS blocks FROM met WHERE shared >= need GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  greatest(CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE 0.0 END, coalesce(part, 0.0)) AS score,
  CAST(coalesce(blocks, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN b USING (row_no) LEFT JOIN m USING (row_no)
"""


ORACLE = _oracle()
