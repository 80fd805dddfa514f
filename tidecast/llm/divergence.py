"""Quality by distribution divergence (operator 2): DataFrame functions only.

Each document's histogram of character classes, and its histogram of common words, are compared with the references of all
languages by Jensen-Shannon distance (base 2, square root of the divergence); the nearest language counts. A word is common where it makes up at
least ``COMMON_SHARE`` of a language's words, so a language has at most 1 / COMMON_SHARE of them whatever the corpus size.
References are sums over all documents with a language.

Defined results: a null or empty text has no words and fails the base rule; rows without a language are judged but do
not enter a reference; without any reference only the base rule decides; below the minimum lengths a distance does not
count; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidecast.llm.common import query, scan, stored, words

COMMON_SHARE = 0.003
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.85
#: Character classes, taken off one after the other; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "space": r"[\x20\x09-\x0D]+", "letter": r"\p{L}+", "digit": r"\p{N}+",
           "stop": "[.,;:!?'\"()-]+"}
SYMBOLS = "[#*$%&|<>]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words which the text holds twice or more."""
    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def found_twice(s: Column) -> Column:
        twin = F.filter(s, lambda e, k: (F.get(s, k + 1)["h"] == e["h"]) | ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])))
        return let(F.array_sort(F.transform(twin, lambda e: e["i"])), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, found_twice))

    def of_words(x: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(size)])
        return let(F.transform(F.sequence(F.lit(0), F.size(x) - size), window), of_hashes)

    return F.when(F.size(w) <= size, F.lit(0)).otherwise(let(w, of_words)).cast("long")


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds w (the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (df.withColumn("w", words(F.col(text)))
            .withColumn("n_words", F.size("w").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
            .withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", repeated_words(F.col("w"))))


def class_counts(text: str = "text") -> Column:
    """Characters of each class, as an array in the order of ``CLASSES`` and the rest."""
    def peel(t: Column, patterns: list[str], counts: list[Column]) -> Column:
        if not patterns:
            return F.array(*counts, F.length(t))
        return let(F.regexp_replace(t, patterns[0], ""),
                   lambda left: peel(left, patterns[1:], [*counts, F.length(t) - F.length(left)]))
    return peel(F.coalesce(F.col(text), F.lit("")), list(CLASSES.values()), [])


def common_words(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n, total, hash) of every common word of every language, over all rows with a language."""
    known = df.where(F.col(lang).isNotNull())
    counts = stored(known.select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word"))
                    .groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return (counts.join(total, "lang").where(F.col("n") >= F.col("total") * COMMON_SHARE)
            .withColumn("hash", F.xxhash64("word")))


class WordTable:
    """Common words in a table without collisions, so that each word is found by one look."""

    def __init__(self, rows):
        self.words = sorted({r["word"] for r in rows})
        hashes = {r["word"]: r["hash"] for r in rows}
        size = 4 * len(self.words) + 1
        while len({hashes[w] % size for w in self.words}) < len(self.words):
            size += 2
        self.size, self.rest = size, len(self.words)
        slots, codes = [""] * size, ["0"] * size
        for k, w in enumerate(self.words):
            slots[hashes[w] % size], codes[hashes[w] % size] = w, str(k)
        self.slots = F.split(F.lit(" ".join(slots)), " ")
        self.codes = F.split(F.lit(" ".join(codes)), " ").cast("array<int>")

    def code(self, word: Column) -> Column:
        at = F.pmod(F.xxhash64(word), F.lit(self.size)).cast("int")
        return let(at, lambda j: F.when(F.get(self.slots, j) == word, F.get(self.codes, j)).otherwise(F.lit(self.rest)))

    def histogram(self, w: Column) -> Column:
        """(code, n) of the common words of an array of words, in code order."""
        found = F.array_sort(F.filter(F.transform(w, self.code), lambda c: c < self.rest))

        def runs(c: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda k: (k == 0) | (F.get(c, k - 1) != F.get(c, k)))
            return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(
                F.get(c, at).alias("code"), (F.coalesce(F.get(b, k + 1), F.size(c)) - at).alias("n"))))

        return let(found, lambda c: F.when(F.size(c) > 0, runs(c)).otherwise(F.expr("array()").cast("array<struct<code:int,n:int>>")))


def reference(values: list[float]) -> Column:
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def distance(shares: Column, q: Column, base: Column) -> Column:
    """Jensen-Shannon distance of a sparse histogram (code, p) from the reference that begins at ``base`` in ``q``."""
    def step(acc: Column, e: Column) -> Column:
        p, r = e["p"], F.get(q, base + e["code"])
        half = F.when(p > 0, p * F.log2(2 * p / (p + r))).otherwise(0.0) + F.when(r > 0, r * F.log2(2 * r / (p + r))).otherwise(0.0)
        return F.struct((acc["d"] + half / 2).alias("d"), (acc["r"] + r).alias("r"))

    total = F.aggregate(shares, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("r")), step)
    return let(total, lambda x: F.sqrt(F.greatest(F.lit(0.0), x["d"] + (1 - x["r"]) / 2)))


def nearest(shares: Column, q: Column, languages: int, width: int) -> Column:
    return let(shares, lambda s: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(languages - 1)), lambda k: distance(s, q, k * width))))


def quality(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, base measures, base_failed, char_distance, word_distance, kept) of every row.

    The text is read twice: once for the word counts, once for everything else, which is written as narrow rows.
    The references (languages times at most 1 / COMMON_SHARE words) are the only data that goes through the driver.
    """
    common = common_words(df, text, lang).collect()
    table = WordTable(common)
    languages = sorted({r["lang"] for r in common})
    narrow = base_measures(df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t")), "t")
    narrow = stored(narrow.select(
        F.col("k").alias(key), "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.length(F.coalesce("t", F.lit(""))).alias("chars"), class_counts("t").alias("classes"),
        table.histogram(F.col("w")).alias("hist")), "quality")
    width = len(CLASSES) + 1
    sums = {r["lang"]: r for r in narrow.where(F.col("lang").isNotNull()).groupBy("lang").agg(
        *[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(width)]).collect()}
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if not languages:
        out = narrow.withColumn("char_distance", F.lit(0.0)).withColumn("word_distance", F.lit(0.0))
    else:
        chars, places = [], {w: k for k, w in enumerate(table.words)}
        words_q = [[0.0] * (table.rest + 1) for _ in languages]
        for k, name in enumerate(languages):
            all_chars = sum(sums[name][f"c{j}"] for j in range(width)) or 1
            chars += [sums[name][f"c{j}"] / all_chars for j in range(width)]
            for r in common:
                if r["lang"] == name:
                    words_q[k][places[r["word"]]] = r["n"] / r["total"]
            words_q[k][table.rest] = 1 - sum(words_q[k])
        share = F.transform("classes", lambda c, k: F.struct(k.alias("code"), (c / F.greatest("chars", F.lit(1))).alias("p")))
        n = F.greatest("n_words", F.lit(1))
        seen = F.transform("hist", lambda e: F.struct(e["code"].alias("code"), (e["n"] / n).alias("p")))
        rest = F.aggregate("hist", F.col("n_words"), lambda a, e: a - e["n"]) / n
        spread = F.concat(seen, F.array(F.struct(F.lit(table.rest).alias("code"), rest.alias("p"))))
        out = (narrow.withColumn("char_distance", nearest(share, reference(chars), len(languages), width))
               .withColumn("word_distance", nearest(spread, reference(sum(words_q, [])), len(languages), table.rest + 1)))
    near = (((F.col("chars") < MIN_CHARS) | (F.col("char_distance") <= MAX_CHAR_DISTANCE))
            & ((F.col("n_words") < MIN_WORDS) | (F.col("word_distance") <= MAX_WORD_DISTANCE)))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & near).alias("kept"), "char_distance", "word_distance")


@query("op2_divergence")
def op2_divergence(spark, folder):
    """Base rules and divergence verdict of all whole documents."""
    return quality(scan(spark, folder, "documents"))
