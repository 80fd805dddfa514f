"""N-gram Jaccard join by grouped prefixes (operator 8).

A document's set is its distinct word shingles. Two documents link when their sets have a Jaccard similarity of at least
``PERCENT`` percent. Everything is exact but for collisions of 64-bit hashes.

* Equal sets are one class; classes with the same size and the same prefix are one group, and prefix lists hold groups, so copies never meet each
  other. A task sends the prefix of a group once.
* Shingles are ordered by hash, but frequent ones come last, by frequency. Any order is right; this one keeps lists of
  shared passages short, and a copy with edits of its own has them first, so that it meets others only if it is near enough. How frequent a shingle is is told from the whole sets of one class in
  ``ORDER_ONE_IN``, chosen by hash, which is enough to find those of large groups; this sets the order only, all sets are joined. (Counts of prefixes would not do: behind the
  frequent shingles of a prefix come others as frequent that were in no prefix.) The table of late shingles has at most ``MAX_LATE`` entries, whatever the corpus; with more, only the most frequent move.
* A set's prefix is long enough that linked sets share ``SHARED`` prefix shingles (fewer for tiny sets). Pairs with fewer are no candidates, nor are pairs that meet at places from which
  on the sets are too short for a link: documents that only share a passage meet late, as its shingles come last.
* The hub of a list is the group with the fewest early shingles in its prefix: the one with the least of its own, as an original among its edited copies. So the lists of near copies have the same hub.
* Round one compares each member of a list with the hub, and each class of a group with one of the group, and joins what links. Round two
  lists the pairs that are still in different components. So a large group of near copies costs about one comparison a member, and yet no
  link between components is lost.
* Candidates are verified on whole sets. Those are worked out again from the text, for classes that are candidates only (a
  bit filter of fixed size says which; the join drops its false positives).

Defined results: fewer words than a shingle make one shingle of the whole sequence; null and empty texts and texts without words have no shingle and
are their own component; a null id is never linked to by its id (the least non-null id of its component names it); repeated rows are copies; other
columns are not read; an empty table gives an empty result. Texts of any length are handled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import drop_worker_cache, query, row_slices, scan, stored
from tidecast.llm.graph import components
from tidecast.llm.hashing import ODD, mixed, window_hashes, word_hashes

WORDS, PERCENT, SHARED = 5, 80, 3
ORDER_ONE_IN, LATE_FROM, MAX_LATE = 16, 2, 1_000_000
FILTER_BITS = 1 << 26
SLICE_BYTES = 1 << 20


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of every text."""
    h, first = word_hashes(column)
    windows = window_hashes(h, WORDS)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            s = np.sort(windows[a:b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed((h[a:b] * ODD[:b - a]).sum(keepdims=True) + np.array([b - a], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = (mixed(s ^ ODD[1]) * ODD[2]).sum(keepdims=True) + np.array([len(s)], np.uint64) * ODD[3]
    return int(mixed(total).view(np.int64)[0])


def least_shared(n: int) -> int:
    """Prefix shingles that a set of this size shares with any set it links to."""
    return min(SHARED, -(-PERCENT * n // 100))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + least_shared(n)


def prefix(s: np.ndarray, late: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order, and how many of them are early. ``late`` is sorted; ``order`` gives the place of each among them."""
    n = prefix_length(len(s))
    if not len(late):
        return s[:n], n
    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
    moved = late[at] == s
    if not moved.any():
        return s[:n], n
    early = s[~moved]
    if len(early) >= n:
        return early[:n], n
    return np.concatenate([early, s[moved][np.argsort(order[at[moved]])][:n - len(early)]]), len(early)


def batches_of(batches, columns: int):
    for part in row_slices(batches, columns, SLICE_BYTES):
        yield [part.column(j) for j in range(columns)], shingle_sets(part.column(columns))


def late_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least ``LATE_FROM`` of the classes that tell the order, and their places by frequency."""
    def run(batches):
        drop_worker_cache()
        seen = set()
        for _, sets in batches_of(batches, 0):
            found = []
            for s in sets:
                if len(s) and (name := fingerprint(s)) % ORDER_ONE_IN == 0 and name not in seen:
                    seen.add(name)
                    found.append(s)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    counts = texts.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    often = stored(counts.where(F.col("n") >= LATE_FROM), "late-shingles")
    least, total = LATE_FROM, 0
    for r in often.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():
        total += r["k"]
        if total > MAX_LATE:
            least = r["n"] + 1
            break
    got = often.where(F.col("n") >= least).toPandas()
    late = got["shingle"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(late)
    late, n = late[by], got["n"].to_numpy(np.int64)[by]
    order = np.empty(len(late), np.int64)
    order[np.lexsort((late, n))] = np.arange(len(late))
    return late, order


def signed(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, fp, g, early, prefix) of every document: set size, class, group, and the prefix, of which ``early`` shingles are not late, where this task names the group first."""
    late = docs.sparkSession.sparkContext.broadcast(late_shingles(docs.select("text")))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        drop_worker_cache()
        seen = set()
        for (ids,), sets in batches_of(batches, 1):
            n, fps, gs, earlies, prefixes = [], [], [], [], []
            for s in sets:
                if not len(s):
                    n.append(0), fps.append(None), gs.append(None), earlies.append(0), prefixes.append(None)
                    continue
                p, early = prefix(s, *late.value)
                g = fingerprint(np.concatenate([p, [np.uint64(len(s))]]))
                n.append(len(s)), fps.append(fingerprint(s)), gs.append(g), earlies.append(early), prefixes.append(None if g in seen else p.view(np.int64))
                seen.add(g)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(gs, pa.int64()), pa.array(earlies, pa.int32()),
                                              pa.array(prefixes, pa.list_(pa.int64()))], [key, "n", "fp", "g", "early", "prefix"])

    return stored(docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n bigint, fp bigint, g bigint, early int, prefix array<bigint>"), "signed")


def wanted_bits(pairs: DataFrame) -> np.ndarray:
    """A filter of fixed size over the classes in ``pairs``."""
    fp = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    at = fp.select(F.explode(F.array(F.pmod("fp", F.lit(FILTER_BITS)), F.pmod(F.shiftright("fp", 30), F.lit(FILTER_BITS)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["k"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) that link, by their whole sets."""
    pairs = stored(pairs, "pairs")
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(pairs))

    def sets(batches):
        drop_worker_cache()
        seen, words = set(), bits.value.view(np.uint64)
        for _, found in batches_of(batches, 0):
            names, values = [], []
            for s in found:
                if len(s):
                    fp = fingerprint(s)
                    at = (fp % FILTER_BITS, (fp >> 30) % FILTER_BITS)
                    if fp not in seen and all(int(words[k >> 6]) >> (k & 63) & 1 for k in at):
                        seen.add(fp)
                        names.append(fp), values.append(s.view(np.int64))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["fp", "shingles"])

    whole = docs.select("text").mapInArrow(sets, "fp bigint, shingles array<bigint>")
    whole = stored(whole.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")
    left = pairs.join(whole.withColumnRenamed("shingles", "sa"), F.col("a") == F.col("fp")).drop("fp")
    full = left.join(whole.withColumnRenamed("shingles", "sb"), F.col("b") == F.col("fp")).select("a", "b", "sa", "sb")

    same = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * same >= PERCENT * (F.size("sa") + F.size("sb") - same)
    return stored(full.where(linked).select("a", "b"), "links")


def like_sizes(x: str, y: str):
    return (100 * F.col(x) >= PERCENT * F.col(y)) & (100 * F.col(y) >= PERCENT * F.col(x))


def enough_left(n: str, at: str, m: str, to: str):
    """From a shared shingle on, both sets still hold what a link needs. Holds for the first ``SHARED`` common shingles of sets that link, so their count stands."""
    need = F.ceil((F.col(n) + F.col(m)) * PERCENT / (100 + PERCENT))
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) >= need - (SHARED - 1)


def ordered(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(v, c): the component of every class that has a link."""
    classes = stored(marks.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("g").alias("g")), "classes")
    groups = classes.groupBy("g").agg(F.min("fp").alias("head"), F.first("n").alias("n"), F.count("*").alias("k"))
    post = marks.where("prefix is not null").select("g", "n", "early", F.posexplode("prefix").alias("at", "shingle")).repartition("shingle").distinct()
    sizes = post.groupBy("shingle").agg(F.count("*").alias("k"), F.min(F.struct("early", "n", "g", "at")).alias("hub")).where("k > 1")
    lists = stored(post.join(sizes, "shingle").select("shingle", "g", "n", "at", F.col("hub.g").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at")), "lists")
    need = F.least(F.lit(SHARED), F.ceil(F.least("n", "m") * PERCENT / 100))

    # round one: hubs
    star = (lists.where("g <> hub").where(like_sizes("n", "hub_n") & enough_left("n", "at", "hub_n", "hub_at")).groupBy("g", "hub").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("hub_n").alias("m"))
            .where(F.col("k") >= need))
    head = groups.select(F.col("g").alias("_g"), "head")
    star = star.join(head, star["g"] == F.col("_g")).select("hub", F.col("head").alias("x")).join(head, F.col("hub") == F.col("_g"))
    inner = classes.join(groups.where("k > 1").select("g", "head"), "g").where("fp <> head").select(F.col("fp").alias("x"), "head")
    first = verified(star.select("x", "head").union(inner).select(*ordered("x", "head")).distinct(), docs)
    comp = components(first)

    # round two: pairs in different components
    labelled = classes.join(comp, classes["fp"] == comp["v"], "left").select("fp", "n", "g", F.coalesce("c", "fp").alias("c"))
    labelled = stored(labelled, "labelled")
    spans = labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    of_group = lists.join(spans, "g")
    hub = spans.select(F.col("g").alias("hub"), F.col("lo").alias("hub_c"))
    of_group = of_group.join(hub, "hub").select("shingle", "g", "n", "at", "lo", "hi", ((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("hub_c"))).alias("odd"))
    of_group = stored(of_group, "spans")
    other = of_group.select("shingle", F.col("g").alias("og"), F.col("n").alias("m"), F.col("at").alias("oat"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.col("odd").alias("oodd"))
    apart = (F.col("lo") != F.col("olo")) | (F.col("lo") != F.col("hi")) | (F.col("olo") != F.col("ohi"))
    met = of_group.where("odd").join(other, "shingle").where((F.col("g") != F.col("og")) & (~F.col("oodd") | (F.col("g") < F.col("og")))
                                                             & apart & like_sizes("n", "m") & enough_left("n", "at", "m", "oat"))
    met = met.select(*ordered("g", "og"), "n", "m").groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m")).where(F.col("k") >= need)
    one = labelled.select(F.col("g").alias("a"), F.col("fp").alias("x"), F.col("c").alias("xc"))
    two = labelled.select(F.col("g").alias("b"), F.col("fp").alias("y"), F.col("c").alias("yc"))
    across = met.select("a", "b").join(one, "a").join(two, "b").where("xc <> yc")
    mixed_groups = spans.where("lo <> hi").select("g", "lo")
    within = labelled.join(mixed_groups, "g")
    mate = labelled.select("g", F.col("fp").alias("y"), F.col("c").alias("yc"))
    within = within.where("c <> lo").join(mate, "g").where((F.col("c") != F.col("yc")) & ((F.col("yc") == F.col("lo")) | (F.col("fp") < F.col("y"))))
    second = across.select("x", "y").union(within.select(F.col("fp").alias("x"), "y")).select(*ordered("x", "y")).distinct()
    return components(first.union(verified(second, docs)))


def jaccard_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, class_id, component_id) per document: size of its set, least id with the same set, least id that links reach."""
    marks = signed(docs, key)
    comp = links(docs, marks)
    least = marks.where("n > 0").groupBy("fp").agg(F.min(key).alias("class_id"))
    named = least.join(comp, least["fp"] == comp["v"], "left").select("fp", "class_id", F.coalesce("c", "fp").alias("c"))
    named = stored(named, "named")
    heads = named.groupBy("c").agg(F.min("class_id").alias("component_id"))
    ids = stored(named.join(heads, "c").select("fp", "class_id", "component_id"), "ids")
    own = F.col(key)
    return marks.select(key, "n", "fp").join(ids, "fp", "left").select(
        key, F.col("n").alias("n_shingles"), F.coalesce("class_id", own).alias("class_id"), F.coalesce("component_id", own).alias("component_id"))


COMPONENTS_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    u AS (SELECT doc_id, len(w) AS size, unnest(w) AS w0, unnest(range(len(w))) AS p FROM t), l AS (SELECT doc_id, p, size, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3,
        lead(w0, 4) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    g AS (SELECT DISTINCT doc_id, concat_ws(' ', w0, w1, w2, w3, w4) AS g FROM l WHERE w4 IS NOT NULL OR (size < 5 AND p = 0)),
    x AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM g), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b, n = m AND k = n AS same FROM both_ WHERE 100 * k >= 80 * (n + m - k)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(c.b, t.doc_id)) AS class_id, least(t.doc_id, coalesce(r.b, t.doc_id)) AS component_id
    FROM t LEFT JOIN (SELECT doc_id, any_value(n) AS n FROM x GROUP BY 1) x USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM link WHERE same GROUP BY 1) c ON c.a = t.doc_id
    LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) r ON r.a = t.doc_id"""


@query("op8_jaccard_join", COMPONENTS_SQL)
def op8_jaccard_join(spark, folder):
    """Components of all whole documents."""
    return jaccard_components(scan(spark, folder, "documents", "doc_id", "text"))
