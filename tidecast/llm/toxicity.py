"""Toxicity by a weighted finite-state pattern grammar (operator 6).

Five transducers read the symbols of a clause side by side: insult and threat words add their weight, a target, a negation
or a reporting verb changes the state. Their composition is one deterministic machine whose states tell what a clause holds
(threat, target, negated, reported); when the clause ends, its summed weight goes to the channel of its state.
A document's score is a logistic function of its channel sums and of the density of matched clauses; a lone word counts only
through the clause it stands in.

What is learned, from rows outside the hold-out only: the weights of words and of word beginnings (stems that take any ending),
as log odds between toxic and clean documents, and the logistic coefficients. The coefficients start from the grammar's prior
(targets and threats raise, negation and report lower a clause) and are fitted on documents whose own half did not make the weights.
Learning reads at most ``LABELLED`` labelled documents of each label, chosen by hash: a documented bound, everything else reads every row.

Defined results: a null or empty text, and one without any match, gets the score of an empty channel vector; without labels of both kinds the lexicon
is empty and every score is the base rate (0 if there are none); labels that contradict each other for an id are both used; repeated rows are
scored one by one; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import map_batches, query, remainder, scan, stored, words, worker_cache

LABELLED = 10_000
MAX_ENTRIES = 20_000
STEM_LENGTHS = (4, 5, 6, 7)
MIN_DOCS, MIN_ODDS = 5, 3.5
#: Least Poisson deviance of an entry's toxic documents against the base rate: among a million entries none by chance.
MIN_EVIDENCE = 8.0
THRESHOLD = 0.3
CACHE_ENTRIES = 300_000
# fixed values: function words of the grammar
TARGETS = "you your yourself u he she they them him her those these du dich dir ihr euch sie tu toi vous ils elles tú te usted ustedes ellos ellas"
NEGATIONS = "not no never nobody none n't without nicht kein keine nie niemals ne pas jamais aucun sans nunca ni sin jamás"
REPORTS = "said says say called calls wrote reported quoted according claims sagte sagt schrieb laut dit disait écrit selon dijo dice según escribió"
THREATS = "kill hurt destroy shoot burn attack die töten schlagen zerstören vernichten tuer frapper détruire matar golpear destruir"

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n]")


class Transducer:
    """Arcs (state, symbol) -> state; a symbol without an arc keeps the state. ``final`` names what a state tells."""

    def __init__(self, name: str, symbol: int, lasts: bool = True):
        self.name, self.states = name, 2
        self.arcs = {(0, symbol): 1}
        if not lasts:  # forgotten at the next match
            self.arcs |= {(1, INSULT): 0, (1, THREAT): 0}


def compose(machines: list[Transducer]) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """The reachable product of machines that read the same symbols: (next state by state and symbol, what each state tells)."""
    begin = (0,) * len(machines)
    order, table, queue = {begin: 0}, [], [begin]
    for state in queue:
        row = []
        for symbol in range(END):
            to = tuple(m.arcs.get((s, symbol), s) for m, s in zip(machines, state))
            if to not in order:
                order[to] = len(order)
                queue.append(to)
            row.append(order[to])
        table.append(row)
    return np.array(table), [tuple(m.name for m, s in zip(machines, state) if s) for state in queue]


GRAMMAR, TELLS = compose([Transducer("insult", INSULT), Transducer("threat", THREAT), Transducer("target", TARGET),
                          Transducer("negated", NEGATION), Transducer("reported", REPORT)])
CHANNELS = ("plain", "targeted", "threat", "negated", "reported")
#: Prior effect of a unit of weight in each channel; per clause, and of the density.
PRIOR = np.array([1.0, 1.2, 1.2, 0.7, 0.7, 1.0])
NEXT = GRAMMAR.tolist()


def channel_of(tells: tuple[str, ...]) -> int:
    for name, channel in (("reported", 4), ("negated", 3), ("threat", 2), ("target", 1)):
        if name in tells:
            return channel
    return 0


CHANNEL = [channel_of(t) for t in TELLS]


class Lexicon:
    """Symbol and weight of a word: the grammar's own words, then learned words, then the longest learned stem."""

    def __init__(self, weights: dict[str, float], stems: dict[str, float]):
        self.weights, self.stems = weights, stems
        self.fixed = {w: k for k, text in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in text.split()}
        self.threats = set(THREATS.split())
        self.known: dict[str, tuple[int, float] | None] = {c: (END, 0.0) for c in ".!?;:,\n"}

    def look(self, word: str) -> tuple[int, float] | None:
        w = word.lower()
        weight = self.weights.get(w)
        if weight is None:
            weight = next((self.stems[w[:n]] for n in sorted(STEM_LENGTHS, reverse=True) if len(w) > n and w[:n] in self.stems), None)
        if weight is not None:
            return (THREAT if w in self.threats else INSULT), weight
        return (self.fixed[w], 0.0) if w in self.fixed else None

    def of(self, word: str) -> tuple[int, float] | None:
        if word not in self.known:
            if len(self.known) > CACHE_ENTRIES:
                self.known = {c: (END, 0.0) for c in ".!?;:,\n"}
            self.known[word] = self.look(word)
        return self.known[word]


def channels(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Channel sums of a text, and the logarithm of matched weight per hundred words."""
    out = np.zeros(len(CHANNELS) + 1)
    if not text:
        return out
    tokens = TOKEN.findall(text)
    state, weight, hit = 0, 0.0, False
    known, of = lexicon.known, lexicon.of
    for t in tokens:
        e = known[t] if t in known else of(t)
        if e is None:
            continue
        symbol, w = e
        if symbol == END:
            if hit:
                out[CHANNEL[state]] += weight
                weight, hit = 0.0, False
            state = 0
        else:
            state = NEXT[state][symbol]
            if symbol == INSULT or symbol == THREAT:
                weight, hit = weight + w, True
    if hit:
        out[CHANNEL[state]] += weight
    out[-1] = math.log1p(100 * out[:-1].sum() / len(tokens)) if tokens else 0.0
    return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, text, y, half): at most about LABELLED documents of each label, chosen by the hash of the id."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(4) != 2))
    train = train.select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for y, k in n.items():
        share = F.when(F.col("y") == y, min(1.0, LABELLED / k)).otherwise(share)
    # both tables of ids are bounded by LABELLED ids of each label, some 30 bytes each
    sampled = docs.select("doc_id", "text").join(F.broadcast(train.where(hashed < share)), "doc_id")
    first = stored(sampled.groupBy("y", sketch("text").alias("copies")).agg(F.min("doc_id").alias("doc_id")), "toxicity-ids")
    ids = first.groupBy("doc_id", "y").agg(F.min("copies").alias("copies"))
    ids = ids.select("doc_id", "y", F.pmod(F.xxhash64("copies"), F.lit(2)).cast("int").alias("half"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def sketch(text: str, size: int = 5):
    """The least hash of a text's word windows: near copies mostly share it, so that copies of one toxic document do not
    make all its words look toxic, and stay within one half."""
    w = words(F.col(text))
    window = lambda x, i: F.xxhash64(*[F.get(x, i + k) for k in range(size)])
    least = F.transform(F.array(w), lambda x: F.array_min(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - size)), lambda i: window(x, i))))[0]
    return least


def learn(rows: DataFrame) -> tuple[dict, dict]:
    """Weights of words and stems by half: keys 0 and 1 hold what the half's own documents gave, 2 what all gave."""
    seen = (rows.select("y", "half", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"[\p{L}]{2,}"), F.lit(0)))).alias("word"))
        .groupBy("word").agg(*[F.count_if((F.col("y") == y) & (F.col("half") == h)).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]))
    sizes = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    parts = [F.struct(F.lit(0).alias("stem"), F.col("word").alias("entry"))]
    parts += [F.when(F.length("word") > n, F.struct(F.lit(n).alias("stem"), F.substring("word", 1, n).alias("entry"))) for n in STEM_LENGTHS]
    counted = (seen.select(F.explode(F.array_compact(F.array(*parts))).alias("e"), *[f"n{y}{h}" for y in (0, 1) for h in (0, 1)])
               .groupBy("e.stem", "e.entry").agg(*[F.sum(f"n{y}{h}").alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)])
               .where(F.col("n10") + F.col("n11") >= MIN_DOCS))

    def odds(halves):
        one, zero = (sum((F.col(f"n{y}{h}") for h in halves), F.lit(0)) for y in (1, 0))
        n1, n0 = (sum(sizes.get((y, h), 0) for h in halves) for y in (1, 0))
        usual = (one + zero) * (n1 / max(1, n1 + n0))
        sure = one * F.log(F.greatest(one, F.lit(1)) / F.greatest(usual, F.lit(1e-9))) - (one - usual) >= MIN_EVIDENCE
        return F.when((one >= MIN_DOCS) & sure, F.log((one + 0.5) / (n1 + 1.0)) - F.log((zero + 0.5) / (n0 + 1.0)))

    kept = (counted.select("stem", "entry", odds([0]).alias("w0"), odds([1]).alias("w1"), odds([0, 1]).alias("w2"))
            .where(F.greatest("w0", "w1", "w2") >= MIN_ODDS)
            .orderBy(F.desc("w2"), "stem", "entry").limit(MAX_ENTRIES).collect())
    whole, stems = {}, {}
    for k in range(3):
        whole[k] = {r["entry"]: r[f"w{k}"] for r in kept if r["stem"] == 0 and (r[f"w{k}"] or 0) >= MIN_ODDS}
        stems[k] = {r["entry"]: r[f"w{k}"] for r in kept if r["stem"] > 0 and (r[f"w{k}"] or 0) >= MIN_ODDS}
    return whole, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 3.0) -> np.ndarray:
    """Intercept and coefficients, drawn to ``prior``; Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    centre = np.concatenate([[0.0], prior])
    b, pull = centre.copy(), np.diag([1e-3, *[strength] * x.shape[1]])
    b[0] = -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pull, z.T @ (y - p) - pull @ (b - np.where(centre == 0, 0, centre)))
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    b[1:] = np.maximum(b[1:], 0)
    return b


class Model:
    def __init__(self, words: dict, stems: dict, coefficients: np.ndarray, base_rate: float | None):
        self.words, self.stems, self.coefficients, self.base_rate = words, stems, coefficients, base_rate

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        if self.base_rate is not None:
            return self.base_rate
        z = self.coefficients[0] + channels(text, lexicon) @ self.coefficients[1:]
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    whole, stems = learn(rows)

    def features(batch: pa.RecordBatch) -> list:
        pair = [Lexicon(whole[1 - h], stems[1 - h]) for h in (0, 1)]
        x = np.array([channels(t, pair[h]) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())])
        return [batch.column(1), pa.array(list(x), pa.list_(pa.float64()))]

    got = map_batches(rows.select("text", "y", "half"), features, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return Model({}, {}, np.zeros(len(PRIOR) + 1), float(y.mean()) if len(y) else 0.0)
    x = np.array([r["x"] for r in got])
    return Model(whole[2], stems[2], fit_logistic(x, y, PRIOR / 4), None)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, then score and predicted, in one narrow pass over whole texts."""
    # at most MAX_ENTRIES entries
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.coefficients, model.base_rate))
    name = f"toxicity_{uuid.uuid4().hex}"
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> list:
        m = Model(*shared.value)
        lexicon = worker_cache(name, lambda: Lexicon(m.words, m.stems))
        s = [m.score(t, lexicon) for t in batch.column(len(keep)).to_pylist()]
        return [*batch.columns[:len(keep)], pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())]

    return map_batches(docs.select(*keep, F.col("text").alias("_text")), run,
                       ", ".join([*(f"{c} {kinds[c]}" for c in keep), "score double", "predicted int"]))


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    """Toxicity of all whole documents."""
    docs = scan(spark, folder, "documents", "doc_id", "text")
    model = fit(docs, scan(spark, folder, "labels", "doc_id", "toxic"))
    return score(docs.withColumn("held_out", remainder(4) == 2), model, "doc_id", "held_out")
