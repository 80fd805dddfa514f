"""Language-model scores from a log-frequency Bloom filter (operator 9).

Counts of words and word pairs over all training texts are quantised on a log scale (level 1 + log of the count to base ``BASE``) and
put into one Bloom filter of fixed size: an n-gram of level q is inserted q times, once with each number up to q. A count is read
back by probing 1, 2, 3 … until one is missing, so it is never below the stored level. The filter is broadcast; its size is a constant.

Pairs are pairs of classes: each of the ``CLASS_WORDS`` most frequent words is its own class, every other word belongs to the class of its
last two bytes. P(v | u) = LAMBDA * pair(u, v) / context(u) * share(v) + (1 - LAMBDA) * (word(v) + 1) / (N + V + 1), where share is 1 for a frequent word
and otherwise that of the word in its class; every number is a probe. Where the n-grams of the whole corpus do not fit at the
designed error, those with counts below the smallest cut-off for which the rest fits are not put into the filter but joined: a probe below the level of the cut-off says that an n-gram is not
stored, and its count, quantised likewise, then comes from the count tables. So the size of the filter decides what is joined, not what is counted.

The base score needs exact counts of every word. The ``HEAD`` most frequent words are broadcast with exact counts; all other
occurrences are joined with the count table, so the base is exact at any vocabulary size.

What is joined is dealt by hash to buckets, one for each ``BUCKET_BYTES`` of text, with the counts of the same hashes; the tokens of a slice that go to a
bucket travel as one row of packed arrays, with the number of each token's row in the slice. A bucket returns one packed row for each slice that has tokens in
it, with one sum for each row of the slice that has: never more sums than tokens. The number of a row is that of its slice and its place in the slice.

Defined results: null and empty texts are one end token; without training texts N = V = 0 and every token has the smoothed
probability of an unseen one; a null id counts as remainder 0, in training; repeated rows are counted and scored one by one; words are told apart by 64-bit hashes;
other columns are not read. Texts of any length are read whole; a task holds a slice of rows and its bounded tables, or the look-ups and counts of a bucket.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import drop_worker_cache, query, remainder, row_slices, scan, stored, worker_cache
from tidecast.llm.hashing import LOWER, mixed, span_hashes, utf8, word_spans

BASE, LAMBDA = 1.5, 0.6
BLOCKS, BLOCK_BITS, PROBES = 1024, 1 << 18, 4
CAPACITY = 40_000_000
HEAD, CLASS_WORDS, CLASSES = 1 << 17, 40_000, 1 << 16
END = np.uint64(0x5DEECE66D1CE4E5B)
MAX_LEVEL = 1 + int(np.ceil(np.log(1e13) / np.log(BASE)))
WORD_SALT, CONTEXT_SALT, PAIR_SALT = (np.uint64(x) for x in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93, 0x52DCE729E6546B64))
SLICE_BYTES, ROW_BITS, FLUSH = 1 << 21, 15, 2_000_000
SLICE_ROWS = 1 << ROW_BITS
BUCKET_BYTES, PACK = 1 << 26, 1 << 18


def tokens(column: pa.Array):
    """(word hashes with an end token after each text, class by suffix of each token, first token of each text)."""
    text, at = utf8(column)
    text = LOWER[text]
    starts, ends, first = word_spans(text, at)
    h, n = span_hashes(text, starts, ends), len(first) - 1
    last = text[ends - 1].astype(np.int64) if len(ends) else np.empty(0, np.int64)
    before = np.where(ends - starts > 1, text[np.maximum(ends - 2, 0)], 0) if len(ends) else last
    suffix = CLASS_WORDS + 1 + (last * 251 + before) % (CLASSES - CLASS_WORDS - 1)
    place = first[1:]
    return np.insert(h, place, END), np.insert(suffix, place, 0), first + np.arange(n + 1)


def slices(batches, columns: int):
    for run in row_slices(batches, columns, SLICE_BYTES):
        for k in range(0, run.num_rows, SLICE_ROWS):
            part = run.slice(k, SLICE_ROWS)
            yield [part.column(j) for j in range(columns)], tokens(part.column(columns))


class Tally:
    """Counts of 64-bit keys, merged when they grow."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)

    def take(self) -> pa.RecordBatch:
        k, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["h", "n"])


def counted(texts: DataFrame, keys_of) -> DataFrame:
    """(h, n): keys of all texts, counted in the task first."""
    def run(batches):
        tally = Tally()
        for _, found in slices(batches, 0):
            tally.add(keys_of(*found))
            if tally.size > FLUSH:
                yield tally.take()
        if tally.parts:
            yield tally.take()

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int, weight=lambda n: 1) -> int:
    """The least count so that what is counted at least that often fits into ``most``."""
    total = 0
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        total += r["k"] * int(weight(r["n"]))
        if total > most:
            return r["n"] + 1
    return 1


def level(n):
    """The level of a count, or of an array of counts of at least 1."""
    return (1 + np.floor(np.log(n) / np.log(BASE) + 1e-9)).astype(np.int64)


class Lookup:
    """Values of sorted 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]

    def of(self, h: np.ndarray, missing: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), missing, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], missing)


def level_hash(keys: np.ndarray, step: int) -> np.ndarray:
    """The bits from which all probes of a level are taken."""
    return mixed(keys + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def positions(h: np.ndarray, probe: int) -> np.ndarray:
    """Bit of a key's block for one probe of a level."""
    return ((h >> np.uint64(15 * probe)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def block_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> np.uint64(54)).astype(np.int64)


def levels_of(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The stored level of each key, by probing until a level is missing."""
    out, live, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), block_of(keys) * BLOCK_BITS
    for step in range(1, MAX_LEVEL + 1):
        h = level_hash(keys[live], step)
        for probe in range(PROBES):
            at = base + positions(h, probe)
            held = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, h, base = live[held], h[held], base[held]
            if not len(live):
                return out
        out[live] = step
    return out


def count_at(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: its geometric middle."""
    return np.where(levels > 1, BASE ** (levels - 0.5), levels.astype(float))


STANDS = count_at(np.arange(MAX_LEVEL + 1))


def chances(pair, context, mass, word, n: int, v: int) -> np.ndarray:
    """Probabilities by the levels of pair, context, class (-1: a frequent word) and word."""
    held, times = STANDS[pair], STANDS[word]
    seen = np.minimum(1.0, held / np.maximum(np.maximum(STANDS[context], held), 1.0))
    share = np.where(mass < 0, 1.0, np.minimum(1.0, (times + 0.5) / (1.5 * np.maximum(1.0, STANDS[mass]))))
    return LAMBDA * seen * share + (1 - LAMBDA) * np.minimum(1.0, (times + 1) / (n + v + 1))


def filter_bits(entries: DataFrame) -> np.ndarray:
    """The filter over (h, n): blocks are filled by tasks and put together; each block holds a thousandth of what fits."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block_of(keys))], ["h", "n", "block"])

    def fill(key, table):
        keys = table.column("h").to_numpy().view(np.uint64)
        top = level(table.column("n").to_numpy())
        bits = np.zeros(BLOCK_BITS, bool)
        for step in range(1, int(top.max()) + 1):
            h = level_hash(keys[top >= step], step)
            for probe in range(PROBES):
                bits[positions(h, probe)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    got = (entries.mapInArrow(run, "h bigint, n bigint, block bigint").groupBy("block").applyInArrow(fill, "block bigint, bits binary"))
    out = np.zeros(BLOCKS * BLOCK_BITS // 8, np.uint8)
    for r in got.toLocalIterator():
        out[r["block"] * (BLOCK_BITS // 8):(r["block"] + 1) * (BLOCK_BITS // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def classes_of(h: np.ndarray, suffix: np.ndarray, own: Lookup) -> np.ndarray:
    c = own.of(h, -1)
    return np.where(c >= 0, c, suffix)


def pair_keys(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Key of each token's class after the class before it; the first of a text follows an end."""
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[first[:-1]] = 0
    return (before.astype(np.uint64) << np.uint64(20)) | c.astype(np.uint64)


def train(docs: DataFrame) -> dict:
    """The model: N, V, stored counts, and what is broadcast. ``docs`` are the training texts."""
    texts = docs.select("text")
    unigrams = stored(counted(texts, lambda h, suffix, first: h), "unigrams")
    n, v = (x or 0 for x in unigrams.agg(F.sum("n"), F.count("*")).first())
    least = least_count(unigrams, HEAD)
    head = unigrams.where(F.col("n") >= least).toPandas()  # at most HEAD rows
    keys, counts = head["h"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    top = np.lexsort((keys, -counts))[:CLASS_WORDS]
    top = top[keys[top] != END]
    own = Lookup(np.append(keys[top], END), np.append(np.arange(1, len(top) + 1), 0))
    shared_own = docs.sparkSession.sparkContext.broadcast((own.keys, own.values))

    def of_pairs(h, suffix, first):
        look = Lookup.__new__(Lookup)
        look.keys, look.values = shared_own.value
        return pair_keys(classes_of(h, suffix, look), first)

    pairs = stored(counted(texts, of_pairs), "pairs")
    context = pairs.groupBy(F.shiftright("h", 20).alias("h")).agg(F.sum("n").alias("n"))

    def salted(df, salt):
        return df.select(F.col("h").bitwiseXOR(F.lit(int(salt))).alias("h"), "n")

    contexts = salted(context, CONTEXT_SALT)  # at most CLASSES rows, never cut
    entries = salted(unigrams, WORD_SALT).union(salted(pairs, PAIR_SALT))
    cut = least_count(entries.union(contexts), CAPACITY, level)
    bits = filter_bits(entries.where(F.col("n") >= cut).union(contexts))
    context = levels_of(np.arange(CLASSES, dtype=np.uint64) ^ CONTEXT_SALT, bits).astype(np.int8)
    return {"n": n, "v": v, "unigrams": unigrams, "pairs": pairs, "least": least, "cut": cut, "context": context,
            "shared": (cut, keys, counts, own.keys, own.values, context, bits)}


class Scorer:
    def __init__(self, n, v, cut, keys, counts, own_keys, own_values, context, bits):
        self.n, self.v, self.bits = n, v, bits
        self.stored = level(np.array([cut]))[0] if cut > 1 else 0  # a probe below says that the filter does not hold a key
        self.head, self.own = Lookup(keys, counts), Lookup(own_keys, own_values)
        self.context = context.astype(np.int64)
        held = levels_of(self.head.keys ^ WORD_SALT, bits)
        if len(held):
            held = np.where(held < self.stored, level(self.head.values), held)
        self.head_words = Lookup(self.head.keys, held)

    def read(self, keys: np.ndarray, salt: np.uint64) -> np.ndarray:
        """The levels that the filter holds; -1 where it says that a key may have been left out."""
        levels = levels_of(keys ^ salt, self.bits)
        return np.where(levels < self.stored, -1, levels)

    def score(self, h, suffix, first):
        """Per token: exact head count (-1: not in the head), log10 probability (0 where a count is to be joined); the places of the tokens with such
        counts, their pairs of classes, and their levels of pair and word (-1: to be joined)."""
        unique, back = np.unique(h, return_inverse=True)
        known = self.head.of(unique, -1)
        word = self.head_words.of(unique, 0)
        rare = np.flatnonzero(known < 0)
        word[rare] = self.read(unique[rare], WORD_SALT)
        c = self.own.of(unique, -1)[back]
        c = np.where(c >= 0, c, suffix)
        pairs, again = np.unique(pair_keys(c, first), return_inverse=True)
        before, pair = self.context[(pairs >> np.uint64(20)).astype(np.int64)], self.read(pairs, PAIR_SALT)
        context, held = count_at(before), count_at(pair)
        seen = np.minimum(1.0, held / np.maximum(np.maximum(context, held), 1.0))[again]
        times, word = count_at(word)[back], word[back]
        share = np.where(c <= CLASS_WORDS, 1.0, np.minimum(1.0, (times + 0.5) / (1.5 * np.maximum(1.0, count_at(self.context)[c]))))
        p = LAMBDA * seen * share + (1 - LAMBDA) * np.minimum(1.0, (times + 1) / (self.n + self.v + 1))
        rest = (pair[again] < 0) | (word < 0)
        at = np.flatnonzero(rest)
        return known[back], np.log10(np.where(rest, 1.0, p)), at, short_pairs(pairs[again[at]]), pair[again[at]].astype(np.int8), word[at].astype(np.int8)


def masses(context: np.ndarray) -> np.ndarray:
    """The level of each class, -1 for that of a frequent word."""
    return np.where(np.arange(CLASSES) <= CLASS_WORDS, np.int8(-1), context)


def short_pairs(keys: np.ndarray) -> np.ndarray:
    """Pair keys in 32 bits: a class has 16."""
    return ((keys >> np.uint64(20) << np.uint64(16)) | (keys & np.uint64(CLASSES - 1))).astype(np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The buckets that occur, and the values of each column for each of them as bytes."""
    by = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[by], return_index=True)
    return [pa.array(found.astype(np.int32)), *(pa.array([x.tobytes() for x in np.split(c[by], at[1:])][:len(found)], pa.binary()) for c in columns)]


def dealt_counts(counts: DataFrame, buckets: int, packed) -> DataFrame:
    """(bucket, keys, counts): (h, n) packed by bucket. ``packed`` makes the keys and counts to pack of both."""
    def run(batches):
        parts, size = [], 0

        def take():
            keys, values = packed(*(np.concatenate(x) for x in zip(*parts)))
            return pa.RecordBatch.from_arrays(dealt(bucket_of(keys, buckets), keys, values), ["bucket", "keys", "counts"])

        for batch in batches:
            parts.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > PACK:
                yield take()
                parts, size = [], 0
        if size:
            yield take()

    return counts.select("h", "n").mapInArrow(run, "bucket int, keys binary, counts binary")


def unpacked(table: pa.Table, keys, values) -> Lookup:
    """The counts of a bucket."""
    return Lookup(*(np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("keys", keys), ("counts", values))))


def records(table: pa.Table):
    """(row numbers, words, pairs, levels) of each packed row; None for what it does not have. Row numbers are counted from rid, or whole where that is null."""
    for r in table.select(["rid", "rows", "words", "pairs", "levels"]).to_batches():
        for rid, rows, *fields in zip(*(c.to_pylist() for c in r.columns)):
            rows = np.frombuffer(rows, np.int64) if rid is None else np.frombuffer(rows, np.int16) + np.int64(rid)
            yield rows, *(x if x is None else np.frombuffer(x, kind) for x, kind in zip(fields, (np.uint64, np.uint32, np.int8)))


def with_counts(lookups: DataFrame, counts: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of the packed look-ups and counts of each bucket."""
    def of_bucket(key, left, right):
        drop_worker_cache()
        return run(left, right)

    return lookups.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(of_bucket, schema)


def word_levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, level(np.maximum(counts, 1)), 0)


def by_row(rows: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    found, at = np.unique(rows, return_inverse=True)
    return [found, *(np.bincount(at, x) for x in values)]


SUMS = "slice bigint, rows binary, known binary, base binary, score binary"


def by_slice(parts: list) -> pa.Table:
    """The sums of a bucket, (row numbers, known, base, score) each, as one packed row for each slice."""
    rows, *values = by_row(*(np.concatenate(x) for x in zip(*parts))) if parts else [np.empty(0, np.int64), *[np.empty(0)] * 3]
    found, at = np.unique(rows >> ROW_BITS, return_index=True)
    columns = [(rows & (SLICE_ROWS - 1)).astype(np.int16), values[0].astype(np.int32), *values[1:]]
    packed = [pa.array([x.tobytes() for x in np.split(c, at[1:])][:len(found)], pa.binary()) for c in columns]
    return pa.table([pa.array(found), *packed], ["slice", "rows", "known", "base", "score"])


def of_slice(key, table):
    """One row for each row of a slice of which there are sums."""
    kinds = (np.int16, np.int32, np.float64, np.float64)
    rows, *values = by_row(*(np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in zip(("rows", "known", "base", "score"), kinds)))
    return pa.table([rows + np.int64(key[0].as_py() << ROW_BITS), values[0].astype(np.int64), *values[1:]], ["rid", "more", "more_logs", "rest_logs"])


LOOKUPS = "kind tinyint, bucket int, rows binary, words binary, pairs binary, levels binary"
#: What a packed row asks for: the count of words, that and the probability where the pair is known, the level of a word whose pair is to be joined next, or of a pair.
WORDS, SCORED_WORDS, FIRST_WORDS, PAIRS = range(4)


def joined_sums(lookups: DataFrame, model: dict, buckets: int) -> DataFrame:
    """(rid, more, more_logs, rest_logs): what the joined counts add to the known tokens, the base score and the score of a row."""
    n, v, context = model["n"], model["v"], model["context"]
    mass, cut = masses(context), model["cut"]

    def logs(pairs, pair_levels, words):
        return np.log10(chances(pair_levels, context[pairs >> 16], mass[pairs & (CLASSES - 1)], words, n, v))

    def plain(keys, counts):
        return keys, counts

    def count_words(left, right):
        table, out = unpacked(right, np.uint64, np.int64), []
        for rows, words, pairs, levels in records(left):
            counts = table.of(words, 0)
            more = np.zeros(len(rows)) if pairs is None else logs(pairs, levels, word_levels(counts))
            out.append(by_row(rows, counts > 0, np.log10(counts + 1.0), more))
        return by_slice(out)

    def level_words(left, right):
        table = unpacked(right, np.uint64, np.int64)
        got = [(rows, pairs, word_levels(table.of(words, 0)).astype(np.int8)) for rows, words, pairs, _ in records(left)]
        rows, pairs, levels = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int8))
        bucket, *fields = dealt(bucket_of(pairs, buckets), rows, pairs, levels)
        return pa.table([bucket, *fields], ["bucket", "rows", "pairs", "levels"])

    def level_pairs(left, right):
        table, out = unpacked(right, np.uint32, np.int8), []
        for rows, _, pairs, levels in records(left):
            found, more = by_row(rows, logs(pairs, table.of(pairs, 0), levels))
            out.append((found, np.zeros(len(found)), np.zeros(len(found)), more))
        return by_slice(out)

    def short(keys, counts):
        return short_pairs(keys), level(counts).astype(np.int8)

    fields = ["bucket", "rid", "rows", "words", "pairs", "levels"]
    rare = dealt_counts(model["unigrams"].where(F.col("n") < model["least"]), buckets, plain)
    out = with_counts(lookups.where(F.col("kind").isin(WORDS, SCORED_WORDS)).select(fields), rare, count_words, SUMS)
    if cut > 1:
        words = dealt_counts(model["unigrams"].where(F.col("n") < cut), buckets, plain)
        later = with_counts(lookups.where(F.col("kind") == FIRST_WORDS).select(fields), words, level_words, "bucket int, rows binary, pairs binary, levels binary")
        later = later.select("bucket", F.lit(None).cast("bigint").alias("rid"), "rows", F.lit(None).cast("binary").alias("words"), "pairs", "levels")
        pairs = dealt_counts(model["pairs"].where(F.col("n") < cut), buckets, short)
        out = out.union(with_counts(lookups.where(F.col("kind") == PAIRS).select(fields).union(later), pairs, level_pairs, SUMS))
    return out.groupBy("slice").applyInArrow(of_slice, "rid bigint, more bigint, more_logs double, rest_logs double")


def scored(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    n, v = model["n"], model["v"]
    shared, name = docs.sparkSession.sparkContext.broadcast(model["shared"]), f"scorer_{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType.simpleString()
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    names = [key, "rid", "n_tokens", "known", "logs", "score", *(f.split()[0] for f in LOOKUPS.split(", "))]

    def run(batches):
        serial = TaskContext.get().partitionId() << 40  # names rows; the result is stored before it is used twice
        for (ids,), (h, suffix, first) in slices(batches, 1):
            model_here = worker_cache(name, lambda: Scorer(n, v, *shared.value))
            exact, logs, rest, pairs, pair_levels, word_levels = model_here.score(h, suffix, first)
            known, at = exact > 0, first[:-1]
            base = np.add.reduceat(np.where(known, np.log10(np.maximum(exact, 0) + 1.0), 0.0), at)
            of_docs = [ids, pa.array(np.arange(serial, serial + len(at))), pa.array(np.diff(first).astype(np.int64)),
                       pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(base), pa.array(np.add.reduceat(logs, at))]
            yield pa.RecordBatch.from_arrays([*of_docs, pa.nulls(len(at), pa.int8()), pa.nulls(len(at), pa.int32()), *(pa.nulls(len(at), pa.binary()) for _ in range(4))], names)
            row = np.repeat(np.arange(len(at), dtype=np.int16), np.diff(first))
            no_word, no_pair = word_levels < 0, pair_levels < 0
            plain = exact < 0
            plain[rest[no_word & ~no_pair]] = False
            plain = np.flatnonzero(plain)
            packed = [(WORDS, row[plain], h[plain], None, None)]
            for what, which, levels in ((SCORED_WORDS, no_word & ~no_pair, pair_levels), (FIRST_WORDS, no_word & no_pair, None), (PAIRS, ~no_word, word_levels)):
                place = rest[which]
                packed.append((what, row[place], None if what == PAIRS else h[place], pairs[which], None if levels is None else levels[which]))
            for what, rows, words, of_pairs, levels in packed:
                if len(rows):
                    bucket, *values = dealt(bucket_of(of_pairs if words is None else words, buckets), rows, *(x for x in (words, of_pairs, levels) if x is not None))
                    size, values = len(bucket), iter(values)
                    fields = [next(values), *(pa.nulls(size, pa.binary()) if x is None else next(values) for x in (words, of_pairs, levels))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(size, ids.type), pa.array(np.full(size, serial)), *(pa.nulls(size, x.type) for x in of_docs[2:]),
                         pa.array(np.full(size, what, np.int8)), bucket, *fields], names)
            serial += SLICE_ROWS

    first_pass = stored(docs.select(key, "text").mapInArrow(
        run, f"{key} {kind}, rid bigint, n_tokens bigint, known bigint, logs double, score double, {LOOKUPS}"), "lm-scores")
    joined = joined_sums(first_pass.where(F.col("kind").isNotNull()), model, buckets)
    out = first_pass.where(F.col("kind").isNull()).select(key, "rid", "n_tokens", "known", "logs", "score").join(joined, "rid", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return out.select(key, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
                      base.alias("base_score"), (F.col("score") + F.coalesce("rest_logs", F.lit(0.0))).alias("score"))


@query("op9_bloom_lm")
def op9_bloom_lm(spark, folder):
    """Scores of all whole documents under a model of those outside the hold-out."""
    docs = scan(spark, folder, "documents", "doc_id", "text")
    out = scored(docs, train(docs.where(remainder(7) != 2)))
    return out.select("doc_id", (remainder(7) == 2).alias("held_out"), *out.columns[1:])
