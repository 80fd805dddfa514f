"""Filter interaction audit (operator 13): what every order of five filters keeps, removes and loses.

Failing documents are found per filter and united by id: A to D are expressions of the row; E is an existential self-join, a left-semi join
of the documents with themselves on hash, exact text and smaller doc_id. "Some row with this text has a smaller id" holds exactly when the row with the smallest
id of that text has one, so the right side is reduced before the join to one row per text held twice or more (``texts_by_id``).
The id sets are united, reduced to one bit combination per document and counted per part: at most 32 combinations times two labels. All orders, steps and Shapley sums
are computed from those counts, because what a step does depends only on the set of filters before it.

Hot keys: a text that a third of all rows hold is one row on the right; the rows on the left are narrow and salted.

Defined results: a null text is empty (no words, equal to every empty text); a null source is the part ''; a row with a null doc_id has no
smaller id and is nobody's smaller id, so it never fails E, nor does a repeated row whose other copies have the same id; repeated rows are counted each; a label
holds if any row of ``labels`` with the id says so; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.llm.common import query, scan, stored, words

FILTERS = "ABCDE"
SALTS = 32
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT = 200, 50, 2
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def row_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    w = words(text)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {"A": F.size(w) < MIN_WORDS, "B": 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PCT * F.size(w),
             "C": 100 * upper > MAX_UPPER_PCT * F.length(text), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(fails[f], 1 << FILTERS.index(f)).otherwise(0) for f in fails), F.lit(0))


def texts_by_id(docs: DataFrame) -> DataFrame:
    """(h, t, first, n): the smallest id of each text and the number of rows with an id; combined before the shuffle, so a frequent text is one row a task."""
    return docs.where(F.col("doc_id").isNotNull()).groupBy("h", "t").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h) of the rows of (doc_id, part, h, t) whose text a row with a smaller id holds.

    Texts that share a hash are told apart by the texts themselves. Where a hash has one text, rows with the hash hold that text, and the join needs no text: its left rows are
    narrow and dealt over ``SALTS`` keys, and its right rows, one per text held twice, are repeated for each (so it
    grows with the input and is not broadcast). Hashes of several texts, if there are any, are joined with the text.
    """
    per_text = texts_by_id(docs)
    per_hash = stored(per_text.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
                      .where("n > 1 OR texts > 1"), "hashes")
    rows = docs.select("doc_id", "part", "h").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    sole = per_hash.where("texts = 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    found = rows.join(sole.hint("merge"), (rows["h"] == sole["h"]) & (rows["salt"] == sole["salt"]) & (sole["first"] < rows["doc_id"]), "left_semi").drop("salt")
    shared = per_hash.where("texts > 1").select("h")
    if shared.isEmpty():
        return found
    some = per_text.where("n > 1").join(shared, "h", "left_semi")
    same = (docs["h"] == some["h"]) & (docs["t"] == some["t"]) & (some["first"] < docs["doc_id"])
    return found.unionByName(docs.join(some, same, "left_semi").select("doc_id", "part", "h"))


def bit_counts(documents: DataFrame, labels: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(part, bits, good, toxic, n): rows per combination of failed filters and labels. The result is the same for any ``digest`` that tells the texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), digest(text).alias("h"), text.alias("t"))
    each = docs.select("doc_id", "part", "h", row_failures(F.col("t")).alias("bits"), F.lit(1).alias("n"))
    again = repeats(docs).select("doc_id", "part", "h", F.lit(1 << FILTERS.index("E")).alias("bits"), F.lit(0).alias("n"))
    united = each.unionByName(again).groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    no = F.lit(False)
    return united.join(marks, "doc_id", "left").groupBy(
        "part", "bits", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def every_step(spark) -> DataFrame:
    """(filter_order, step, f, before): the filter of each step of each order, and the bits of those before it; 600 rows whatever the data."""
    rows = [("".join(p), k + 1, FILTERS.index(f), sum(1 << FILTERS.index(b) for b in p[:k]))
            for p in permutations(FILTERS) for k, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, f int, before int")


def audit(documents: DataFrame, labels: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(part, filter_order, step, counts, shapley): 600 rows per part."""
    cells = (bit_counts(documents, labels, digest).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))))
             .withColumn("before", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
             .withColumn("bit", F.expr("shiftleft(1, f)")).where("before & bit = 0"))
    fails, earlier = F.expr("bits & bit <> 0"), F.expr("bits & before <> 0")
    held = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": F.expr("bits = bit"),
            "good_lost": fails & ~earlier & F.col("good"), "toxic_lost": fails & ~earlier & F.col("toxic")}
    by_set = cells.groupBy("part", "f", "before").agg(*[F.sum(F.when(held[c], F.col("n")).otherwise(0)).alias(c) for c in COUNTS])
    steps = by_set.join(F.broadcast(every_step(documents.sparkSession)), ["f", "before"])
    return steps.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(W.partitionBy("part", "f")).alias("shapley"))


FAILS_SQL = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
    b AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS bits FROM w),
    m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    d AS (SELECT b.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM b LEFT JOIN m USING (doc_id))"""


def audit_sql() -> str:
    steps = ", ".join(f"('{''.join(p)}', {k + 1}, {1 << FILTERS.index(f)}, {sum(1 << FILTERS.index(x) for x in p[:k])})"
                      for p in permutations(FILTERS) for k, f in enumerate(p))
    return FAILS_SQL + f""", s AS (SELECT * FROM (VALUES {steps}) v(filter_order, step, bit, before)),
    r AS (SELECT part, filter_order, step, bit, count(CASE WHEN bits & (bit | before) = 0 THEN 1 END) AS kept,
        count(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN 1 END) AS removed, count(CASE WHEN bits & bit <> 0 AND bits & before <> 0 THEN 1 END) AS redundant,
        count(CASE WHEN bits = bit THEN 1 END) AS unique_fails, count(CASE WHEN bits & bit <> 0 AND bits & before = 0 AND good = 1 THEN 1 END) AS good_lost,
        count(CASE WHEN bits & bit <> 0 AND bits & before = 0 AND toxic = 1 THEN 1 END) AS toxic_lost FROM d CROSS JOIN s GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


@query("op13_filter_audit", audit_sql())
def op13_filter_audit(spark, folder):
    """Every order of the five filters over all whole documents, by source."""
    return audit(scan(spark, folder, "documents", "doc_id", "text", "source"), scan(spark, folder, "labels", "doc_id", "quality", "toxic"))
