"""License scan, collocations and filter audit against plain Python, with rows that SQL over the given tables does not reach."""
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.conftest import LOWER, WORD, by_id, rows_of
from tests.test_queries import table
from tidecast.llm import audit, collocations as co, licenses as li
from tidecast.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_collocations", "op13_filter_audit"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert table(QUERIES[name](spark, SMALL).toPandas()) == table(con.execute(ORACLES[name]).df())


# --- licenses ----------------------------------------------------------------------------------

def brute_labels(text):
    """(n_words, n_base, first, last, base labels, labels, score) by all windows."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(k, label) for p, label in li.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    best, more = 0.0, set()
    for r in li.Notices().rows:
        for k in range(0, max(1, len(w)), r["stride"]):
            share = len(set(w[k:k + 2 * r["stride"]]) & set(r["words"])) / r["size"]
            if share >= li.CONTAINMENT - 1e-9:
                best, more = max(best, share), more | {r["label"]}
    base = {label for _, label in hits}
    return (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), 1.0 if hits else best)


def found_labels(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


MIT, FREE = li.NOTICES[8][1], li.NOTICES[10][1]
LICENSE_TEXTS = [
    MIT, MIT.upper().replace(" ", "\n"), "x " * 37 + MIT + " y" * 90, MIT.replace("charge, to", "fee to"), MIT.replace("free of charge, to any person", ""),
    " ".join(reversed(FREE.split())), "cc by cc by cc by", "CC-BY! all rights reserved; General\nPublic\tLicense cc", "ccby", "a" * 100_000 + " cc by",
    "released under license the mit", "released under the apache license", "Lıcense cc by", "ofKered licenKe", None, "", "...", "é cc by é",
    "granted " * 5000, ("filler " * 60 + "Licensed under CC BY-NC 4.0. ") * 50]


def test_labels_equal_all_windows(spark, odd, small_docs):
    df = spark.createDataFrame(list(enumerate(LICENSE_TEXTS)), "doc_id bigint, text string").repartition(3)
    got = by_id(li.license_scan(df))
    for k, text in enumerate(LICENSE_TEXTS):
        assert found_labels(got[k]) == brute_labels(text), text
    want = sorted(map(str, ((r.doc_id, *brute_labels(r.text)) for r in rows_of(spark, odd, "documents"))))
    assert want == sorted(map(str, ((r.doc_id, *found_labels(r)) for r in li.license_scan(spark.read.parquet(f"{odd}/documents.parquet")).collect())))


def test_blocks_name_their_place(spark):
    df = spark.createDataFrame([(1, "x " * 37 + MIT + " y" * 90)], "doc_id bigint, text string")
    got = [r for r in li.license_blocks(df).collect() if r.label == "mit"]
    assert got and all(r.first_word == 37 and r.containment == 1.0 for r in got if r.end_word - r.first_word > 18)


# --- collocations ------------------------------------------------------------------------------

def brute_collocations(rows, top=co.TOP):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        names = {p: a for p, a in c.items() if a >= co.LEAST and len(p) >= 2}
        rows = []
        for p, a in names.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in names.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in inside):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found_collocations(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations_equal_plain_counts(spark, small_docs):
    passage = " ".join(f"w{k % 41}" for k in range(700))      # no punctuation: many triggers, repeats within the piece
    rows = ([("en", passage)] * 9 + [(None, "A b\tc  d, a b; É ü é ü é ü!\x0bA  B c")] * 31 + [("", "a b a b a b a b a b")] * 10 + [("en", None), (None, ""), ("x", " . ")]
            + [("en", "two words"), ("de", "x y z x y")] * 30 + [(r.lang, r.text) for r in small_docs])
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    assert found_collocations(co.collocations(df)) == brute_collocations(rows)
    assert found_collocations(co.collocations(df, 3)) == brute_collocations(rows, 3)


def test_chunks_own_every_phrase_once():
    texts = ["a b c", "a", " ", "", " ".join(f"w{k * k % 97}" for k in range(3000)), "same " * 500, "a\t b.c  d e"]
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    owned, triggered = Counter(), 0
    for a, b, _, words, tail in zip(*co.chunk_spans(np.frombuffer(raw, np.uint8), at)):
        c = raw[a:b].decode().split()
        assert len(c) == words
        triggered += tail > 0
        for k in range(1, co.LONGEST + 1):
            owned.update(tuple(c[i:i + k]) for i in range(len(c) - tail) if i + k <= len(c))
    want = Counter()
    for piece in (p for t in texts for p in t.split(".")):
        w = piece.split()
        want.update(tuple(w[i:i + k]) for k in range(1, co.LONGEST + 1) for i in range(len(w) - k + 1))
    assert owned == want and triggered > 50


def test_crowded_bit_table_changes_nothing(spark, monkeypatch):
    rows = [("en", " ".join(f"w{(k * j) % 13}" for k in range(60))) for j in range(1, 60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(co, "known", lambda bits, h: h == h)
    assert found_collocations(co.collocations(df)) == brute_collocations(rows)


def test_large_counts_are_exact(spark):
    a = 10 ** 14 + 1
    df = spark.createDataFrame([("en", "x y", a), ("en", "x", 2 * a + 1), ("en", "y", 3 * a - 7)], "lang string, phrase string, f long")
    assert co.scored(df).collect()[0].score == 2_000_000 * a // (5 * a - 6)


# --- audit -------------------------------------------------------------------------------------

def brute_audit(docs, labels):
    smallest = {}
    for r in docs:
        if r.doc_id is not None:
            smallest[r.text or ""] = min(r.doc_id, smallest.get(r.text or "", math.inf))
    good = {x.doc_id for x in labels if x.quality == 1 and x.doc_id is not None}
    toxic = {x.doc_id for x in labels if x.toxic == 1 and x.doc_id is not None}
    parts = defaultdict(list)
    for r in docs:
        t = r.text or ""
        w = WORD.findall(t)
        fails = {f for f, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)),
                                  ("D", re.search(r"[#$%&*|]", t)), ("E", r.doc_id is not None and smallest[t] < r.doc_id)) if bad}
        parts[r.source or ""].append((fails, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [r for r in rows if r[0] & set(order[:k])]
                here = [r for r in rows if f in r[0] and not r[0] & set(order[:k])]
                out[part, "".join(order), k + 1] = (len(rows) - len(gone) - len(here), len(here), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows),
                                                    sum(r[1] for r in here), sum(r[2] for r in here))
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            out.update({k: (*v, total) for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == f})
    return out


def found_audit(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*audit.COUNTS, "shapley")) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd):
    read = lambda t: spark.read.parquet(f"{odd}/{t}.parquet")
    want = brute_audit(rows_of(spark, odd, "documents"), rows_of(spark, odd, "labels"))
    assert found_audit(audit.audit(read("documents"), read("labels"))) == want


@pytest.mark.parametrize("digest", [F.xxhash64, F.length, lambda t: F.lit(0)], ids=["hash", "length", "constant"])
def test_equal_hashes_of_different_texts(spark, digest):
    texts = ["ab", "cd", "ab", "", None, "cd", "ef", "a b", "ab"] * 3
    docs = spark.createDataFrame([(k * 7 % 27, t, "s", "en", 0) for k, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert found_audit(audit.audit(docs, labels, digest)) == brute_audit(docs.collect(), labels.collect())
