"""Language identification by a linear-chain conditional random field over words (operator 4).

Each word of a text is labelled with a language. Features of a word, lower-cased, in UTF-8 with an edge mark before and after it:
itself, its beginning and end of up to four bytes (affixes), its byte pairs and triples, whether it is in a language's
lexicon of frequent words, and whether it is capitalised; a feature has one weight per language, in a hashed table. Transition weights between neighbouring words are learned with them, so a
passage in another language is followed where it is long enough. Labels come from forward-backward: the posterior of every word. A document's
language is the one with most posterior mass over its words, and the score is its share.

Training maximises the conditional likelihood by gradient steps (Adam) over whole documents, from rows outside the hold-out with a language: at most about
``PER_LANGUAGE`` documents of each language, chosen by the hash of the id (null ids come last) and of at most ``MAX_TRAIN_CHARS`` characters; a documented bound for
the fit alone. Every text is labelled whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any training row every text is ``und``; with
one language everything with a letter is that language; ties go to the language first in order; repeated rows are labelled
one by one; other columns are not read. A word's features are computed once per worker (bounded table), and documents of a batch step through
forward-backward side by side, so cost is linear in the text and memory bounded by the batch.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import map_batches, query, remainder, scan, worker_cache
from tidecast.llm.hashing import mixed, span_hashes

PER_LANGUAGE = 200
MAX_TRAIN_CHARS = 20_000
SLOTS = 1 << 16
EPOCHS, STEP, RIDGE = 4, 0.05, 1e-6
LEXICON_WORDS = 200
CACHE_ENTRIES = 300_000
LANES = 512
#: A word is a run of letters with their marks. The standard module's classes agree, and are faster, where a text has none of ``UNCOMMON``.
WORD, COMMON_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile(r"[^\W\d_]+")
UNCOMMON = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\U0010ffff]")


def words_of(text: str | None) -> list[str]:
    return (WORD if UNCOMMON.search(text) else COMMON_WORD).findall(text) if text else []


class Slots:
    """Feature slots of a list of words, by kind, worked out for all words together."""

    def __init__(self, words: list[str], lexicon: dict[str, list[int]]):
        lower = [w.lower() for w in words]
        raw = np.frombuffer(("\2" + "\3\2".join(lower) + "\3").encode(), np.uint8)
        begin, end = np.flatnonzero(raw == 2), np.flatnonzero(raw == 3) + 1
        self.n = len(words)
        owner = np.repeat(np.arange(self.n), end - begin)
        wide = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
        at = np.arange(len(raw))
        #: (slots, owner): kinds with several features a word, owners ascending; kinds with one.
        self.many, self.one = [], [self.slot(span_hashes(raw, begin, end), 1)]
        for n in (2, 3):
            k = at[at + n <= end[owner]]
            self.many.append((self.slot(sum(wide[k + j] << np.uint64(8 * j) for j in range(n)), n), owner[k]))
        for n in (4, 5):  # an edge mark and up to four letters
            for where, kind in ((begin, n), (np.maximum(begin, end - n), n + 10)):
                self.one.append(self.slot(sum(np.where(where + j < end, wide[where + j], 0) << np.uint64(8 * j) for j in range(n)), kind))
        self.one.append(self.slot(np.array([w[0].isupper() for w in words], np.uint64), 30))
        listed = [(x, k) for k, w in enumerate(lower) if w in lexicon for x in lexicon[w]]
        if listed:
            x, k = map(np.array, zip(*listed))
            self.many.append((self.slot(x.astype(np.uint64), 40), k))

    @staticmethod
    def slot(x: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(x + np.uint64(kind << 56)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = sum((weights[s] for s in self.one), np.zeros((self.n, weights.shape[1]), weights.dtype))
        for s, owner in self.many:
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] += np.add.reduceat(weights[s], first, axis=0)
        return out

    def gradient(self, g: np.ndarray) -> np.ndarray:
        slots = np.concatenate([*self.one, *(s for s, _ in self.many)])
        owner = np.concatenate([*[np.arange(self.n)] * len(self.one), *(o for _, o in self.many)])
        return np.stack([np.bincount(slots, g[owner, y], SLOTS) for y in range(g.shape[1])], axis=1)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posterior of each label of each word, for documents side by side.

    ``emit`` is (documents, words, labels), longest document first; scaled probabilities, so no length underflows.
    With ``pairs``, also the expected number of each transition.
    """
    docs, steps, labels = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    a = np.exp(trans - trans.max())
    alpha, live = np.empty_like(e), np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than t
    alpha[:, 0] = np.exp(start - start.max()) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        n = live[t]
        x = (alpha[:n, t - 1] @ a) * e[:n, t]
        alpha[:n, t] = x / x.sum(1, keepdims=True)
    beta = np.ones((docs, labels))
    expected = np.zeros((labels, labels))
    gamma = alpha
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        right = e[:n, t + 1] * beta[:n]
        if pairs:
            xi = alpha[:n, t, :, None] * a * right[:, None, :]
            expected += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
        b = right @ a.T
        beta[:n] = b / b.sum(1, keepdims=True)
        g = alpha[:n, t] * beta[:n]
        gamma[:n, t] = g / g.sum(1, keepdims=True)
    return gamma, expected


def side_by_side(docs: list[np.ndarray], lanes: int = LANES):
    """Numbers of documents of like length, longest first, so that little is padded."""
    order = sorted((k for k, d in enumerate(docs) if len(d)), key=lambda k: -len(docs[k]))
    at = 0
    while at < len(order):
        longest = len(docs[order[at]])
        take = max(1, min(lanes, 1_000_000 // longest))
        yield order[at:at + take]
        at += take


def fit(texts: list[str], langs: list[str]) -> tuple:
    """(languages, lexicon, weights, start, transitions), as plain values."""
    languages = sorted(set(langs))
    number = {x: k for k, x in enumerate(languages)}
    n = len(languages)
    split = [words_of(t) for t in texts]
    counts: dict[str, dict[str, int]] = {x: {} for x in languages}
    for ws, x in zip(split, langs):
        for w in ws:
            counts[x][w.lower()] = counts[x].get(w.lower(), 0) + 1
    lexicon: dict[str, list[int]] = {}
    for x in languages:
        for w in sorted(counts[x], key=lambda w: (-counts[x][w], w))[:LEXICON_WORDS]:
            lexicon.setdefault(w, []).append(number[x])
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64) for ws in split]
    names = list(ids)
    weights, start, trans = np.zeros((SLOTS, n)), np.zeros(n), np.eye(n) * 2.0
    params = [weights, start, trans]
    first, second, tick = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS if n > 1 else 0):
        order = rng.permutation([k for k, d in enumerate(docs) if len(d)])
        for at in range(0, len(order), 64):
            batch = sorted(order[at:at + 64], key=lambda k: -len(docs[k]))
            lengths = np.array([len(docs[k]) for k in batch])
            used, local = np.unique(np.concatenate([docs[k] for k in batch]), return_inverse=True)
            slots, local = Slots([names[x] for x in used], lexicon), np.split(local, np.cumsum(lengths)[:-1])
            table = slots.emissions(weights)
            emit = np.zeros((len(batch), lengths[0], n))
            for row, x in enumerate(local):
                emit[row, :len(x)] = table[x]
            gamma, expected = forward_backward(emit, lengths, start, trans, pairs=True)
            of_words, seen, g_start = np.zeros((len(used), n)), np.zeros((n, n)), np.zeros(n)
            for row, k in enumerate(batch):
                g = -gamma[row, :len(docs[k])]
                y = number[langs[k]]
                g[:, y] += 1
                np.add.at(of_words, local[row], g / len(docs[k]))
                seen[y, y] += len(docs[k]) - 1
                g_start += g[0]
            tick += 1
            for p, g, m, v in zip(params, (slots.gradient(of_words) / len(batch), g_start / len(batch), (seen - expected) / max(1, lengths.sum())), first, second):
                g = g - RIDGE * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += STEP * (m / (1 - 0.9 ** tick)) / (np.sqrt(v / (1 - 0.99 ** tick)) + 1e-8)
    return languages, lexicon, weights.astype(np.float32), start, trans


class Tagger:
    """A fitted field with the emissions of the words seen so far."""

    def __init__(self, languages, lexicon, weights, start, trans):
        self.languages, self.lexicon, self.weights, self.start, self.trans = languages, lexicon, weights, start, trans
        self.ids: dict[str, int] = {}
        self.rows = np.empty((1024, len(languages)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Numbers for words not seen before."""
        new = sorted(words)
        at = len(self.ids)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[at:at + len(new)] = Slots(new, self.lexicon).emissions(self.weights)
        self.ids.update(zip(new, range(at, at + len(new))))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        split = [words_of(t) for t in texts]
        seen = set().union(*split)
        if not seen <= self.ids.keys():
            if len(self.ids) + len(seen) > CACHE_ENTRIES:
                self.ids.clear()
            self.learn(seen - self.ids.keys())
        docs = [np.fromiter(map(self.ids.__getitem__, ws), np.int32, len(ws)) for ws in split]
        for group in side_by_side(docs):
            lengths = np.array([len(docs[k]) for k in group])
            emit = np.zeros((len(group), lengths[0], len(self.languages)), np.float32)
            for row, k in enumerate(group):
                emit[row, :len(docs[k])] = self.rows[docs[k]]
            gamma, _ = forward_backward(emit, lengths, self.start.astype(np.float32), self.trans.astype(np.float32))
            for row, k in enumerate(group):
                mass = gamma[row, :len(docs[k])].sum(0, dtype=np.float64)
                best = int(mass.argmax())
                out[k] = self.languages[best], float(min(1.0, mass[best] / len(docs[k])))
        return out


def training_sample(docs: DataFrame) -> DataFrame:
    """(text, lang) of at most about PER_LANGUAGE documents of each language; of a text beyond MAX_TRAIN_CHARS, a stretch of that length from a place that the id decides."""
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - MAX_TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
    rows = rows.select("doc_id", "lang", F.substring("text", begin, F.lit(MAX_TRAIN_CHARS)).alias("text"))
    n = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for r in n:
        share = F.when(F.col("lang") == r["lang"], min(1.0, PER_LANGUAGE / r["n"])).otherwise(share)
    return rows.where(hashed < share).select("doc_id", "text", "lang")


def train(docs: DataFrame) -> tuple:
    """Fits the field on the driver on the bounded sample (a few MB), ordered so that reruns agree."""
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]) for r in training_sample(docs).collect())
    return fit([r[2] for r in got], [r[3] for r in got])


def label(docs: DataFrame, model: tuple, *keep: str) -> DataFrame:
    """``keep`` columns, then lang_pred and score, in one narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS rows of weights, whatever the corpus
    name, kinds = f"crf_{uuid.uuid4().hex}", dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> list:
        tagger = worker_cache(name, lambda: Tagger(*shared.value))
        texts = batch.column(len(keep)).to_pylist()
        got = [x for k in range(0, len(texts), 2 * LANES) for x in tagger.label(texts[k:k + 2 * LANES])]
        return [*batch.columns[:len(keep)], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]

    return map_batches(docs.select(*keep, F.col("text").alias("_text")), run,
                       ", ".join([*(f"{c} {kinds[c]}" for c in keep), "lang_pred string", "score double"]))


@query("op4_language_crf")
def op4_language_crf(spark, folder):
    """Language of all whole documents."""
    docs = scan(spark, folder, "documents", "doc_id", "text", "lang")
    return label(docs.withColumn("held_out", remainder(4) == 2), train(docs), "doc_id", "held_out")
