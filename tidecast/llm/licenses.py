"""License scan (operator 11): exact set-similarity join of text blocks with license notices, DataFrame functions only.

Base: places where the words of a phrase stand consecutively.

Join: a notice is the set of its distinct words. A block is a window of ``2 c`` words that begins at a multiple of ``c``, where ``c`` is the power of two that holds the notice, so any run as
long as the notice lies whole in one block. A block matches when it contains at least ``CONTAINMENT`` of the notice's words. Words are ordered by their number
of occurrences in all documents, rarest first; the join finds every match with

* prefix: both sets, in that order, share a word among their first ``size - need + 1`` words, so only those are joined;
* length: a block with fewer than ``need`` words of any notice is left out;
* position: from the first common word on, both sets must still hold ``need`` words.

Pairs that pass are verified by intersection. Words outside every notice are in no intersection, so blocks are restricted to the words of the notices before the shuffle. Notices are a parameter, so their
index is the only broadcast table and does not grow with the documents. Blocks of one document are separate groups, and copies with different ids as well, so no
group holds more than ``2 c`` rows of a document.

Defined results: a null text has no words and no label, and its first and last word are null; labels and score depend on the text alone, so repeated rows get equal results; a
null id is an id of its own; empty tables give an empty result; other columns are not read. The score is 1 for a base label, else the greatest containment found, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidecast.llm.common import query, scan

#: What is not a word: runs of ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONTAINMENT = 0.9
#: (label, notice) of common licenses.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)


class Notices:
    """The notices as sets of words with their sizes; ``rank`` orders all their words."""

    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT):
        self.rows = []
        for k, (label, text) in enumerate(notices):
            w = re.findall("[0-9a-z]+", text.lower())
            size = len(set(w))
            need = next(n for n in range(1, size + 1) if n >= containment * size - 1e-9)
            self.rows.append({"notice": k, "label": label, "words": sorted(set(w)), "size": size, "need": need,
                              "stride": 1 << (len(w) - 1).bit_length()})
        self.words = sorted({w for r in self.rows for w in r["words"]})

    def index(self, spark, rank: dict[str, int]) -> DataFrame:
        """(rank, i, notice, stride, size, need): the words of each notice's prefix with their places."""
        rows = []
        for r in self.rows:
            ordered = sorted(rank[w] for w in r["words"])
            rows += [(k, i, r["notice"], r["stride"], r["size"], r["need"]) for i, k in enumerate(ordered[:r["size"] - r["need"] + 1])]
        return spark.createDataFrame(rows, "rank int, i int, notice int, stride int, size int, need int")

    def sets(self, spark, rank: dict[str, int]) -> DataFrame:
        rows = [(r["notice"], r["label"], sorted(rank[w] for w in r["words"])) for r in self.rows]
        return spark.createDataFrame(rows, "notice int, label string, ranks array<int>")

    def vocabulary(self, spark, rank: dict[str, int]) -> DataFrame:
        """(word, rank, strides): every word of a notice and the block sizes it matters for."""
        rows = [(w, rank[w], sorted({r["stride"] for r in self.rows if w in r["words"]})) for w in self.words]
        return spark.createDataFrame(rows, "word string, rank int, strides array<int>")


def plain(text: Column) -> Column:
    """Words in lower case with a space around each. Only the Kelvin sign becomes an ASCII letter in lower case, so it is made another letter first."""
    gapped = F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")
    spaced = F.regexp_replace(F.concat(F.lit(" "), gapped, F.lit(" ")), "  +", " ")
    return F.lower(F.replace(spaced, F.lit("K"), F.lit("Å")))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" ")))).cast("bigint")


def base_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_base, first_word, last_word, base): what is read off each text by its phrases; ``base`` is the array of their labels."""
    t = docs.select("doc_id", F.xxhash64("text").alias("h"), plain(F.col("text")).alias("t"))
    n_words = spaces(F.col("t")) - 1
    any_phrase = F.col("t").rlike("|".join(f" {p} " for p in PHRASES))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        found = F.instr("t", f" {phrase} ")
        places.append(F.regexp_count("t", F.lit(f"(?<= ){phrase}(?= )")))
        firsts.append(F.when(found > 0, spaces(F.substring(F.col("t"), F.lit(1), found)) - 1))
        rest = spaces(F.substring_index("t", f" {phrase} ", -1))
        lasts.append(F.when(found > 0, n_words - rest - len(phrase.split())))
        labels.append(F.when(found > 0, F.lit(label)))
    none = F.lit(None).cast("bigint")
    return t.select(
        "doc_id", "h", n_words.alias("n_words"),
        F.when(any_phrase, sum(places[1:], places[0])).otherwise(0).cast("bigint").alias("n_base"),
        F.when(any_phrase, F.array_min(F.array(*firsts))).otherwise(none).alias("first_word"),
        F.when(any_phrase, F.array_max(F.array(*lasts))).otherwise(none).alias("last_word"),
        F.when(any_phrase, F.array_compact(F.array(*labels))).otherwise(F.expr("array()").cast("array<string>")).alias("base"))


def word_ranks(docs: DataFrame, notices: Notices) -> dict[str, int]:
    """Places of the notices' words by their occurrences in all documents, rarest first; one row per word of a notice goes to the driver."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(w,) for w in notices.words], "word string")
    found = docs.select(F.explode(F.split(plain(F.col("text")), " ")).alias("word")).join(F.broadcast(known), "word")
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(notices.words, key=lambda w: (counts.get(w, 0), w)))}


def license_blocks(docs: DataFrame, notices: Notices | None = None) -> DataFrame:
    """(doc_id, h, notice, label, containment, first_word, end_word): every block that holds a notice; the words are those of the notices in the block."""
    spark, notices = docs.sparkSession, notices or Notices()
    rank = word_ranks(docs, notices)
    index = notices.index(spark, rank)
    by_rank = {k: w for w, k in rank.items()}
    leading = sorted({by_rank[r["rank"]] for r in index.collect()})
    t = docs.select("doc_id", F.xxhash64("text").alias("h"), plain(F.col("text")).alias("t"))
    t = t.where(F.col("t").rlike(" (?:" + "|".join(leading) + ") "))
    at = t.select("doc_id", "h", F.posexplode(F.split(F.substring(F.col("t"), F.lit(2), F.length("t")), " ")).alias("p", "word"))
    at = at.join(F.broadcast(notices.vocabulary(spark, rank)), "word").select("doc_id", "h", "p", "rank", F.explode("strides").alias("stride"))
    own = F.floor(F.col("p") / F.col("stride"))
    at = at.withColumn("block", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))))
    key = ["doc_id", "h", "stride", "block"]
    blocks = at.groupBy(*key).agg(F.array_sort(F.collect_set("rank")).alias("held"), F.min("p").alias("first_word"), F.max("p").alias("end_word"))
    held = F.size("held")
    pairs = blocks.select("*", F.posexplode("held").alias("j", "rank")).join(F.broadcast(index), ["rank", "stride"])
    pairs = pairs.where((held >= F.col("need")) & (F.col("j") <= held - F.col("need"))
                        & (F.least(F.col("size") - F.col("i"), held - F.col("j")) >= F.col("need")))
    pairs = pairs.groupBy(*key, "notice").agg(*[F.first(c).alias(c) for c in ("held", "size", "need", "first_word", "end_word")])
    both = F.size(F.array_intersect("held", "ranks"))
    return (pairs.join(F.broadcast(notices.sets(spark, rank)), "notice").where(both >= F.col("need"))
            .select("doc_id", "h", "notice", "label", (both / F.col("size")).alias("containment"), "first_word", "end_word"))


def license_scan(docs: DataFrame, notices: Notices | None = None) -> DataFrame:
    """One row per document: base measures, base_labels, labels, score."""
    docs = docs.select("doc_id", "text")
    found = license_blocks(docs, notices).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    rows = base_measures(docs)
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["h"] == found["_h"]), "left")
    more = F.coalesce("more", F.expr("array()").cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def scan_sql() -> str:
    """Every block against every notice, without the filters."""
    def stands(phrase: str) -> str:
        return " AND ".join(f"{c} = '{x}'" for c, x in zip(("word", "w1", "w2"), phrase.split()))

    phrases = " UNION ALL ".join(f"SELECT doc_id, p, '{label}' AS label FROM pl WHERE {stands(p)}" for p, label in PHRASES.items())
    words = ", ".join(f"({r['notice']}, '{r['label']}', '{w}', {r['stride']}, {r['size']}, {r['need']})" for r in Notices().rows for w in r["words"])
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    at1 AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM t),
    pl AS (SELECT *, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM at1 WINDOW o AS (PARTITION BY doc_id ORDER BY p)), b AS ({phrases}),
    base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY 1),
    n AS (SELECT * FROM (VALUES {words}) v(notice, label, word, stride, size, need)),
    hit AS (SELECT doc_id, notice, n.label, size, need, word, unnest(CASE WHEN p >= stride THEN [p // stride, p // stride - 1] ELSE [0] END) AS block
        FROM at1 JOIN n USING (word)),
    found AS (SELECT doc_id, notice, label, block, count(DISTINCT word) / size AS share FROM hit GROUP BY doc_id, notice, label, block, size, need HAVING count(DISTINCT word) >= need),
    more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM found GROUP BY 1)
    SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM t LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


@query("op11_license_scan", scan_sql())
def op11_license_scan(spark, folder):
    """Phrases and license notices in all whole documents."""
    return license_scan(scan(spark, folder, "documents", "doc_id", "text"))
