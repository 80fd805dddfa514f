"""Phrase collocations by prefix-free parsing (operator 12).

Parse: each piece of text (between punctuation and line ends) is cut at content triggers, windows of ``OVERLAP`` words whose hash is a multiple of ``PERIOD``. A chunk
runs from its trigger to the end of the next one, so neighbours overlap by ``OVERLAP`` words, and equal passages give equal chunks wherever they stand. The
dictionary holds each distinct chunk of a language once, with its parse frequency; ``tail`` says how many of its last words belong to the next chunk. A phrase of up to ``OVERLAP + 1`` words lies whole in
the chunk that owns its first word and is counted there alone, weighted by the frequency.

Counts: phrases seen less often than ``LEAST`` are never candidates, nor parts of one, so they need no text. Three passes over the dictionary: sums per 64-bit hash of words
and pairs; sums per hash of those longer phrases whose pairs all passed; then sums per phrase text of what passed. What passed is kept as a bit table of fixed size
(``BITS``) that is built in blocks by tasks and sent to the workers; a collision or a crowded table lets too much through, which the last pass counts exactly and drops.

Scoring is joins and grouping on the frequent phrases. Scores use decimal arithmetic and whole division. The first ``TOP`` phrases of a language are
taken within salted groups first, so that no task ranks a whole language.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each; an empty table gives an empty result; ids and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tidecast.llm.common import query, row_slices, scan, stored
from tidecast.llm.hashing import LOWER, span_hashes, utf8

OVERLAP, PERIOD = 3, 16
LONGEST = OVERLAP + 1
LEAST, COVER_PCT, TOP = 30, 80, 2000
BITS, BLOCK_BITS = 27, 20
SALTS = 64
SLICE_BYTES = 4_000_000
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t")] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
DICTIONARY = "lang string, chunk string, tail int, n long"


def edges(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of marked bytes; a run also begins anew at each place in ``cut``."""
    fresh = np.zeros(len(inside) + 1, bool)
    fresh[cut] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def chunk_spans(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first byte, end byte, first word, words, tail) of every chunk of the lower-cased rows that begin at the bytes ``at``."""
    breaks = BREAK[text]
    starts, ends = edges(~(breaks | BLANK[text]), at)
    if not len(starts):
        return (np.empty(0, np.int64),) * 5
    h = span_hashes(text, starts, ends)
    broken = np.concatenate([[0], np.cumsum(breaks)])[starts] + np.searchsorted(at, starts, side="right") * np.int64(len(text) + 1)
    opens = np.concatenate([[True], broken[1:] != broken[:-1]])          # the word begins a piece
    piece = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    stop = np.append(first[1:], len(starts))[piece]                      # the word after the piece
    window = (h + np.roll(h, -1) * np.uint64(3) + np.roll(h, -2) * np.uint64(7)) * MIX >> np.uint64(40)
    trigger = (window % np.uint64(PERIOD) == 0) & (np.arange(len(h)) + OVERLAP <= stop)
    begin = np.flatnonzero(opens | trigger)
    last = np.append(opens[begin][1:], True)                             # the chunk ends its piece
    stop = np.where(last, stop[begin], np.append(begin[1:], len(h)) + OVERLAP)
    return starts[begin], ends[stop - 1], begin, stop - begin, np.where(last, 0, OVERLAP)


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: (lang, chunk, tail, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, SLICE_BYTES):
            text, at = utf8(batch.column(1))
            text = LOWER[text]
            a, b, _, _, tails = chunk_spans(text, at[:-1])
            langs = batch.column(0).to_pylist()
            row = np.searchsorted(at, a, side="right") - 1
            raw, found = text.tobytes(), Counter()
            for x, y, r, tail in zip(a.tolist(), b.tolist(), row.tolist(), tails.tolist()):
                found[langs[r], raw[x:y], tail] += 1
            merged = Counter()
            for (lang, chunk, tail), n in found.items():
                if b"\t" in chunk or b"  " in chunk:
                    chunk = b" ".join(w for w in chunk.replace(b"\t", b" ").split(b" ") if w)
                merged[lang, chunk, tail] += n
            if merged:
                lang, chunk, tail = zip(*merged)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(chunk, pa.binary()).cast(pa.string()), pa.array(tail, pa.int32()),
                                                  pa.array(merged.values(), pa.int64())], ["lang", "chunk", "tail", "n"])

    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, DICTIONARY).groupBy("lang", "chunk", "tail").agg(F.sum("n").alias("n"))


class Places:
    """The words of a batch of chunks in one row, with the hash of the phrase of each length that begins at each word its chunk owns."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0).to_pylist()
        self.text, at = utf8(batch.column(1))
        self.starts, self.ends = edges(self.text != 32, at[:-1])
        first = np.searchsorted(self.starts, at)
        sizes = np.diff(first)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.starts)) - first[self.of]
        self.left = sizes[self.of] - place
        self.owned = place < (sizes - np.asarray(batch.column(2)))[self.of]
        self.weights = np.asarray(batch.column(3))[self.of]
        seeds = {x: np.uint64(xxhash.xxh64_intdigest(x, seed=1)) for x in set(self.langs)}
        self.seed = np.array([seeds[x] for x in self.langs], np.uint64)[self.of]
        self.hash = span_hashes(self.text, self.starts, self.ends)

    def phrases(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each place, and whether they are a phrase of this chunk."""
        h = self.seed + np.uint64(k + 16 * salt)
        for j in range(k):
            h = (h ^ np.roll(self.hash, -j)) * MIX
            h ^= h >> np.uint64(29)
        return h, self.left >= k


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a row of each distinct key, its sum) of (keys..., weight) columns."""
    *keys, weight = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(weight[order], at) if len(at) else weight[:0]


def known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The leading ``BITS`` bits of each hash, marked in a table of fixed size. Tasks make the blocks; only blocks go to the driver."""
    inner = BITS - BLOCK_BITS
    lead = F.shiftrightunsigned("h", 64 - BITS)
    places = hashes.select(F.shiftright(lead, BLOCK_BITS).cast("int").alias("block"), lead.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("at")).distinct()

    def mark(block: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(1 << BLOCK_BITS, np.uint8)
        table[block["at"].to_numpy()] = 1
        return pd.DataFrame({"block": block["block"].iloc[:1], "bits": [np.packbits(table, bitorder="little").tobytes()]})

    bits = np.zeros((1 << inner, 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in places.groupBy("block").applyInPandas(mark, "block int, bits binary").collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def hash_sums(dictionary: DataFrame, lengths: tuple[int, ...], bits=None) -> DataFrame:
    """(h): hashes of phrases whose sum reaches ``LEAST``. With ``bits`` (a broadcast table of pairs), only phrases whose pairs are all in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, SLICE_BYTES):
            p, parts = Places(batch), []
            if bits is not None:
                pair = known(bits.value, p.phrases(2)[0])
            for k in lengths:
                h, whole = p.phrases(k)
                use = whole & p.owned
                if bits is not None:
                    for j in range(k - 1):
                        use &= np.roll(pair, -j)
                parts.append((h[use], p.weights[use]))
            at, n = summed(parts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in parts])[at].view(np.int64)), pa.array(n)], ["h", "n"])

    sums = dictionary.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= LEAST).select("h")


def phrase_sums(dictionary: DataFrame, bits) -> DataFrame:
    """(lang, phrase, f) of every phrase of up to ``LONGEST`` words with a sum of at least ``LEAST``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1, SLICE_BYTES):
            p, parts, spans = Places(batch), [], []
            for k in range(1, LONGEST + 1):
                h, whole = p.phrases(k)
                use = np.flatnonzero(whole & p.owned & known(bits.value, h))
                parts.append((h[use], p.phrases(k, 1)[0][use], p.weights[use]))     # two hashes of 64 bits tell phrases apart
                spans.append((p.starts[use], p.ends[use + k - 1], p.of[use]))
            at, n = summed(parts)
            if len(at):
                a, b, row = (np.concatenate(c)[at].tolist() for c in zip(*spans))
                raw = p.text.tobytes()
                phrases = pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([p.langs[r] for r in row], pa.string()), phrases, pa.array(n)], ["lang", "phrase", "n"])

    sums = dictionary.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return sums.where(F.col("f") >= LEAST)


def frequent_phrases(dictionary: DataFrame) -> DataFrame:
    context = dictionary.sparkSession.sparkContext
    pairs = bit_table(hash_sums(dictionary, (1, 2)))
    longer = bit_table(hash_sums(dictionary, tuple(range(3, LONGEST + 1)), context.broadcast(pairs)))
    return phrase_sums(dictionary, context.broadcast(pairs | longer))


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates, by the cut of the lowest score. Exact: decimals and whole division."""
    size = F.size(F.split("phrase", " "))
    cuts = phrases.where(size >= 2).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    first = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) div CAST(l + r AS DECIMAL(19, 0))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count among the candidates that hold the phrase."""
    w = F.split("phrase", " ")
    inside = F.expr(f"""flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))""")
    return (phrases.withColumn("w", w).where(F.size("w") >= 3).select("lang", F.explode(inside).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))


def first_of_each(df: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language with their rank, cut in salted groups before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return part.drop("salt").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score). Broadcast: the bit table, whose size is fixed."""
    dictionary = stored(parse(docs), "phrase-dictionary")
    total = dictionary.groupBy("lang").agg(F.sum(F.col("n") * (F.size(F.split("chunk", " ")) - F.col("tail"))).alias("n"))
    phrases = stored(frequent_phrases(dictionary), "phrases")
    found = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left")
    found = found.where(F.col("longer").isNull() | (100 * F.col("longer") < COVER_PCT * F.col("a")))
    return first_of_each(found.drop("longer"), top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase, c FROM "
                               f"(SELECT lang, w, c, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, 5))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {c} AS k, array_to_string(list_slice(w, 1, {c}), ' ') AS first, array_to_string(list_slice(w, {c + 1}, 4), ' ') AS rest FROM c WHERE len(w) > {c}"
                              for c in (1, 2, 3))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(list_slice(w, {i}, {i + k - 1}), ' ') AS phrase, a FROM c WHERE len(w) > {k} AND len(w) >= {i + k - 1}"
                               for k in (2, 3) for i in range(1, 6 - k))
    return rf"""WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS c FROM s GROUP BY 1, 2),
    total AS (SELECT lang, CAST(sum(len(w) * c) AS BIGINT) AS n FROM p GROUP BY 1),
    g AS (SELECT lang, k, phrase, CAST(sum(c) AS BIGINT) AS f FROM ({grams}) GROUP BY 1, 2, 3 HAVING sum(c) >= 30),
    c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
    cut AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.a // (l.f + r.f) AS BIGINT) AS score
        FROM ({cuts}) x JOIN g l ON l.lang = x.lang AND l.phrase = x.first JOIN g r ON r.lang = x.lang AND r.phrase = x.rest),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, phrase, max(a) AS longer FROM ({inner}) GROUP BY 1, 2),
    kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


@query("op12_collocations", collocations_sql())
def op12_collocations(spark, folder):
    """The first phrases of each language over all whole documents."""
    return collocations(scan(spark, folder, "documents", "lang", "text"))
