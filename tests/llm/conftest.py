import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {"documents": DOCUMENTS, "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string",
          "conversations": "conv_id bigint, turn bigint, role string, text string",
          "pages": "page_id bigint, url string, html string"}
LONG = "alpha beta gamma delta <s> [INST] epsilon\n" * 12_000  # half a megabyte
COPY = " ".join(f"word{k}" for k in range(40))


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet").collect()


def by_id(df, key="doc_id"):
    got = df.collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def write_tables(spark, folder, given, extra):
    for name, ddl in TABLES.items():
        df = spark.createDataFrame(given.get(name, []), ddl)
        for column in extra:
            df = df.withColumn(column, F.lit("clash"))
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns with names used inside."""
    docs = [(None, "A text without an id, but words.", "en", "a", 3), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0),
            (3, " \t\n ", None, "b", 3), (4, LONG, "en", "a", len(LONG)), (5, COPY, "en", "a", 1), (5, COPY, "en", "a", 1),
            (6, COPY, None, "b", 1), (7, COPY + " tail", "de", "c", 1), (8, "12 34 !!", "de", "c", 8), (9, "one Two", "en", "a", 7),
            (10, "ONE two", "de", "b", 7), (11, "\u00fc\u4e2d\U0001f600\x00e\u0301 \u00a0x", "de", "\U0001f600", 9), (12, "<|endoftext|> hi", "en", "\ufb01", 1)]
    labels = [(4, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (7, 1, 1), (7, 1, 0), (9, 0, 0), (9, 0, 0), (99, 0, 1)]
    items = [(0, COPY), (1, COPY), (2, None), (3, ""), (4, "short"), (None, COPY.replace("word39", "other"))]
    turns = [(None, 0, "user", "x"), (1, None, "user", None), (1, 0, None, ""), (1, 1, "assistant", "\\[/INST] </s> \\\\"), (1, 1, "assistant", "</s>"),
             (2, 0, "a] <s>", "[INST]"), (2, 1, "assistant", LONG), (2, 2, "system", None)]
    pages = [(None, None, None), (None, "http://a/\r\nX: y", ""), (1, "u", "same"), (2, "u", "same"), (2, "v", "same"), (3, "w", LONG), (4, "w", "\r\n\r\nWARC/1.1\r\n")]
    given = {"documents": docs, "labels": labels, "benchmark": items, "conversations": turns, "pages": pages}
    extra = ("w", "n", "fp", "a", "b", "g", "k", "word", "h", "score", "predicted", "held_out", "size", "payload", "digest", "segment")
    return write_tables(spark, tmp_path_factory.mktemp("odd"), given, extra)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), {}, ())


@pytest.fixture(scope="session")
def small_docs(spark):
    return rows_of(spark, SMALL, "documents")


def brute_components(texts):
    """{id: (set size, least id that links reach)}, by all pairs."""
    sets = {i: frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k:k + 5]) for k in range(len(w) - 4)))
            for i, w in ((i, tokens(t)) for i, t in texts.items())}
    name = {i: i for i in sets}
    ids, holders = sorted(sets), {}
    for i in ids:
        shared = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, both in shared.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), name[i]) for i in ids}
