"""Benchmark decontamination by CGK embedding and bit-sampling (operator 7).

A document holds an item when some run of its words is within ``EDITS`` percent of the item's length in word edits (words: runs of letters, digits and
underscores, lower-cased). The search, over item-sized windows:

1. Windows that cannot match are left out, without loss: d edits leave a run of at least (n - d) / (d + 1) item words intact, so a match
   shares a word run of that length (at most three words) with the item, and a window is placed where such a run would put it.
2. The CGK walk embeds a window: step by step it writes the current word and moves on or stays, as a random bit of (step, word) says. Few
   edits become few differing places. A repeat samples ``SAMPLED`` places of its own walk; the sampled words are the key of a hash table over items.
3. As many repeats are made as reach ``RECALL`` for the items of about one length, by the lower bound of the chance of one repeat, measured on those items with the largest allowed number of
   random edits. Lengths that would need more than ``REPEATS`` (long items: an edit shifts many steps of the walk) skip the tables: every window of step 1 is verified, which misses nothing.
4. Every pair that is left is verified by the exact edit distance between the item and any run of the words around the window; windows that overlap are verified together.

The items are the stated query set: they are read in blocks of at most ``BLOCK_CHARS`` characters, each broadcast to one narrow pass. Texts are searched in slices of
``SLICE_BYTES``, and windows are embedded in blocks of ``CELLS`` words, so memory grows with one text and one item, not with their product.

Defined results: an item of fewer than ``MIN_WORDS`` words is no evidence and is not searched for; null and empty texts hold nothing;
of several places the one with fewest edits, then the first, is given; items with equal texts are found each by its id; repeated rows are searched one by one;
an empty table on either side gives an empty result; other columns are not read. Whole texts are searched, at any length.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import query, row_slices, scan, worker_cache
from tidecast.llm.hashing import mixed

EDITS, RECALL = 20, 0.999
SAMPLED, REPEATS = 2, 160
MIN_WORDS = 6
BLOCK_CHARS = 8_000_000
SLICE_BYTES, CELLS = 4_000_000, 4_000_000
#: Beyond this many words a walk of the table would take more steps than the edit distance; such items are not walked.
LONGEST_WALK = 400
WORD = re.compile(r"\w+")
PAD = -1


def allowed(n: int) -> int:
    return EDITS * n // 100


def intact(n: int) -> int:
    """Words of the run that any match shares with an item of ``n`` words."""
    d = allowed(n)
    return max(1, min(3, (n - d) // (d + 1)))


def length_class(n: np.ndarray) -> np.ndarray:
    """Lengths within about a quarter of each other."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int64)


def runs(sorted_places: list[int], reach: int):
    """Runs of places, no two neighbours of which are further apart than half of ``reach``, cut where they grow beyond four times it."""
    run = sorted_places[:1]
    for at in sorted_places[1:]:
        if at - run[-1] > reach // 2 or at - run[0] > 4 * reach:
            yield run
            run = []
        run.append(at)
    yield run


def sampled_keys(rows: np.ndarray, sizes: np.ndarray, seed: int, symbols: int) -> np.ndarray:
    """The key of each row under one repeat. A row holds word numbers below ``symbols``, ``sizes`` of them, then PAD."""
    steps = 2 * int(sizes.max())
    drawn = np.random.default_rng([7, seed]).random((SAMPLED, 1))
    places = np.sort((drawn * 2 * sizes).astype(np.int64), axis=0)
    places = np.maximum.accumulate(places - np.arange(SAMPLED)[:, None], axis=0) + np.arange(SAMPLED)[:, None]
    #: A random word for each symbol and 64 steps: its bits say whether the walk moves on.
    bits = [mixed(np.arange(symbols + 1, dtype=np.uint64) + np.uint64((1 << 63) + (seed << 40) + (k << 32))) for k in range(steps // 64 + 1)]
    order = np.argsort(-places[-1], kind="stable")
    rows, places = rows[order], places[:, order]
    live = np.searchsorted(-places[-1], -np.arange(steps + SAMPLED), side="right")
    at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
    key = mixed(sizes[order].astype(np.uint64) + np.uint64(seed << 32))
    for step in range(int(places[-1].max()) + 1):
        m = live[step]
        symbol = rows[every[:m], at[:m]]
        for place in places:
            here = np.flatnonzero(place[:m] == step)
            key[here] = mixed(key[here] ^ (symbol[here] + 1).astype(np.uint64))
        move = (bits[step >> 6][symbol + 1] >> np.uint64(step & 63)) & np.uint64(1)
        at[:m] = np.minimum(at[:m] + move.astype(np.int64), rows.shape[1] - 1)
    out = np.empty_like(key)
    out[order] = key
    return out


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(edits, end): the least edit distance of the item to any run of ``words``, and where the first such run ends."""
    j = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for k, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - j) + j
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """One block of items, with seeds, tables and the number of repeats."""

    def __init__(self, rows: list[tuple]):
        split = [(i, WORD.findall((t or "").lower())) for i, t in rows]
        split = [(i, w) for i, w in split if len(w) >= MIN_WORDS]
        self.ids = [i for i, _ in split]
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w]) for _, w in split]
        self.base = len(self.number) + 2
        self.seeds = {}
        for q in (1, 2, 3):
            found = [(c, k, o) for k, it in enumerate(self.items) if intact(len(it)) == q for o, c in enumerate(self.code(it, q).tolist())]
            if found:
                found.sort()
                codes, owner, offset = map(np.array, zip(*found))
                self.seeds[q] = codes, owner, offset
        self.sizes = np.array([len(i) for i in self.items], np.int64)
        #: Repeats by length class; 0 where every window is verified.
        self.repeats = {c: self.needed(np.flatnonzero(length_class(self.sizes) == c)) for c in np.unique(length_class(self.sizes)).tolist()}
        keys = []
        for c, repeats in self.repeats.items():
            members = np.flatnonzero(length_class(self.sizes) == c)
            for r in range(repeats):
                keys += zip(self.keys_of([self.items[j] for j in members], r).tolist(), members.tolist())
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.uint64)
        self.owners = np.array([j for _, j in keys], np.int64)

    @classmethod
    def of(cls, state: dict) -> "Items":
        """From the attributes of another: these travel as plain data."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def keys_of(self, items: list[np.ndarray], repeat: int) -> np.ndarray:
        if not items:
            return np.empty(0, np.uint64)
        sizes = np.array([len(i) for i in items])
        rows = np.full((len(items), sizes.max() + 1), PAD, np.int64)
        for k, i in enumerate(items):
            rows[k, :len(i)] = i
        return sampled_keys(rows, sizes, repeat, self.base)

    def code(self, ids: np.ndarray, q: int) -> np.ndarray:
        out = np.zeros(max(0, len(ids) - q + 1), np.int64)
        for k in range(q):
            out = out * self.base + ids[k:len(ids) - q + 1 + k]
        return out

    def needed(self, members: np.ndarray, copies: int = 400) -> int:
        """Repeats for the target recall in one length class, or 0 where that takes too many. The chance of one repeat is measured on about ``copies`` copies of its items with
        as many random edits as are allowed, and taken two deviations lower."""
        if allowed(int(self.sizes[members].min())) and self.sizes[members].min() > LONGEST_WALK:
            return 0
        rng, hits, tries, edited, source = np.random.default_rng(11), 0, 0, [], []
        for j in np.resize(members, copies).tolist():
            row = self.items[j].tolist()
            for _ in range(allowed(len(row))):
                at, kind = int(rng.integers(len(row))), int(rng.integers(3))
                row[at:at + (kind != 1)] = [] if kind == 0 else [0]
            edited.append(np.array((row + [PAD] * len(self.items[j]))[:len(self.items[j])]))
            source.append(self.items[j])
        for r in range(4):
            same = self.keys_of(edited, r) == self.keys_of(source, r)
            hits, tries = hits + int(same.sum()), tries + len(same)
        p = hits / tries
        p = min(0.95, p - 2 * math.sqrt(p * (1 - p) / tries))
        repeats = math.ceil(math.log(1 - RECALL) / math.log(1 - p)) if p > 0 else REPEATS + 1
        return repeats if repeats <= REPEATS else 0

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """(start, item, place of the run) of every window that an intact run asks for; each (start, item) of a text once."""
        out = []
        for q, (codes, owner, offset) in self.seeds.items():
            known = np.flatnonzero(ids > 0)
            for k in range(1, q):
                known = known[(known + k < len(ids))]
                known = known[ids[known + k] > 0]
            code = np.zeros(len(known), np.int64)
            for k in range(q):
                code = code * self.base + ids[known + k]
            lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
            n = hi - lo
            some = n > 0
            lo, n, where = lo[some], n[some], known[some]
            each = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.column_stack([np.repeat(where, n) - offset[each], owner[each], np.repeat(where, n)]))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)

    def embedded(self, ids: np.ndarray, windows: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, start, item) of the windows (row, start, size) whose key a table holds."""
        found: set[tuple[int, int, int]] = set()
        for c, repeats in self.repeats.items():
            mine = windows[length_class(windows[:, 2]) == c]
            mine = mine[np.argsort(mine[:, 2], kind="stable")]
            step = max(1, CELLS // int(mine[-1, 2] + 1)) if len(mine) else 1
            for part in range(0, len(mine) if repeats else 0, step):
                row, start, n = mine[part:part + step].T
                place = start[:, None] + np.arange(n.max() + 1)
                inside = (place < (start + n)[:, None]) & (place >= begins[row][:, None]) & (place < ends[row][:, None])
                words = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], PAD)
                for r in range(repeats):
                    key = sampled_keys(words, n, r, self.base)
                    lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
                    for k in np.flatnonzero(hi > lo).tolist():
                        found.update((int(row[k]), int(start[k]), int(j)) for j in self.owners[lo[k]:hi[k]])
        return found

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, edits, begin, end) of every item that a text holds; begin and end count words."""
        get = self.number.get
        numbered = [np.fromiter(map(get, WORD.findall(t.lower()), itertools.repeat(0)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        lengths = np.array([len(w) for w in numbered], np.int64)
        begins = np.cumsum(lengths + 1) - lengths                # a gap before each text: no run of words reaches over it
        ends = begins + lengths
        ids = np.full(int((lengths + 1).sum()) + 1, PAD, np.int64)
        for at, w in zip(begins, numbered):
            ids[at:at + len(w)] = w
        hits = self.candidates(ids)
        if not len(hits):
            return []
        row = np.searchsorted(begins, hits[:, 2], side="right") - 1
        hits = np.unique(np.column_stack([row, hits[:, 0], hits[:, 1]]), axis=0)
        whole = np.isin(length_class(self.sizes), [c for c, repeats in self.repeats.items() if not repeats])[hits[:, 2]]
        walked = hits[~whole]
        found = self.embedded(ids, np.unique(np.column_stack([walked[:, :2], self.sizes[walked[:, 2]]]), axis=0), begins, ends)
        pairs: dict[tuple[int, int], list[int]] = {}
        for r, start, j in itertools.chain(found, map(tuple, hits[whole].tolist())):
            pairs.setdefault((r, j), []).append(start)
        out = []
        for (r, j), starts in sorted(pairs.items()):
            item, n, d = self.items[j], len(self.items[j]), allowed(len(self.items[j]))
            best = None
            for near in runs(sorted(starts), 2 * d + n):
                same = next((s for s in near if np.array_equal(ids[s:s + n], item)), None)
                if same is not None:
                    place = (0, same - int(begins[r]), same + n - int(begins[r]))
                    best = min(best or place, place)
                    continue
                first = max(int(begins[r]), near[0] - d)
                words = ids[first:max(first, min(int(ends[r]), near[-1] + n + d))]
                if np.isin(item, words).sum() < n - d:            # each missing word costs an edit
                    continue
                edits, end = best_run(item, words)
                if edits <= d:
                    length = best_run(item[::-1], words[:end][::-1])[1]
                    stop = first + end - int(begins[r])
                    best = min(best or (edits, stop - length, stop), (edits, stop - length, stop))
            if best:
                out.append((r, j, *best))
        return out


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, item_id, n_words, edits, begin_word, end_word) of every item that a document holds."""
    spark = docs.sparkSession
    items = items.select(F.col(item_key).cast("bigint").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, item_id bigint, n_words bigint, edits bigint, begin_word bigint, end_word bigint"
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about BLOCK_CHARS characters
        shared, name = spark.sparkContext.broadcast(vars(Items([tuple(r) for r in rows]))), f"items_{uuid.uuid4().hex}"

        def run(batches, shared=shared, name=name):
            for part in row_slices(batches, 1, SLICE_BYTES):
                block = worker_cache(name, lambda: Items.of(shared.value))
                got = block.search(part.column(1).to_pylist())
                if got:
                    row, j, edits, begin, end = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), pa.array([block.ids[x] for x in j], pa.int64()), pa.array([len(block.items[x]) for x in j], pa.int64()),
                         *(pa.array(c, pa.int64()) for c in (edits, begin, end))], [f.split()[0] for f in schema.split(", ")])

        part = docs.select(key, "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


@query("op7_decontaminate")
def op7_decontaminate(spark, folder):
    """Benchmark items held by any whole document."""
    return contaminated(scan(spark, folder, "documents", "doc_id", "text"), scan(spark, folder, "benchmark"))
