"""Token counts by prefix dynamic programming (operator 1).

For every character prefix of a text the exact number of tokens is stored, as one signed byte per character: the change
against the prefix before. Counts, truncation points and budgets are then running sums; no text is encoded again.

How a byte-pair encoding is found without merging: the encoding of a prefix ends in the one token for which the last
token of the shorter prefix and this token stay apart when the two are merged on their own. So one pass over the prefixes
of a word gives the encoding of all of them. Texts are cut into units first, at places where the library's own cut cannot
depend on what follows; units repeat, so their deltas are kept per worker in a bounded table.

Defined results: a null or empty text has no tokens and an empty table; added tokens of the vocabulary that occur in a text count as one token
each, as in the library, and as plain text in prefixes that end inside them; a change beyond one byte cannot occur, as a character adds at most four tokens
and takes away fewer than 128. Any length is handled, in time linear in the text (a token has at most 128 bytes).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from tidecast.llm.common import map_batches, query, scan, worker_cache

SPLIT = (r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space together with what follows it: whether a run's last character joins the next word shows only there.
UNIT = (r"(?:\s*[^\S ])?'(?:[stmd]|re|ve|ll)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
#: The same units where the standard module's classes agree with the above; it is faster.
COMMON_UNIT = r"(?:\s*[^\S ])?'(?:[stmd]|re|ve|ll)|\s*(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+"
UNCOMMON = "[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\U0010ffff]"
PLAIN = r" ?(?:\p{L}+|\p{N}+|(?!')[^\s\p{L}\p{N}]+)"
CACHE_ENTRIES = 400_000
LIMIT = 512


class PrefixCounter:
    """Token counts of all prefixes under a byte-level pair vocabulary."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        byte_of = {c: b for b, c in byte_letters().items()}
        self.ids = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        #: How each token is made, as (rank, left, right); rank by pair.
        self.made, self.rank = {bytes([b]): (-1, None, None) for b in range(256)}, {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(map(byte_of.__getitem__, a)), bytes(map(byte_of.__getitem__, b))
            self.rank[a, b] = k
            self.made.setdefault(a + b, (k, a, b))
        self.longest = max(map(len, self.ids))
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split, self.unit, self.plain = regex.compile(SPLIT), regex.compile(UNIT), regex.compile(PLAIN)
        self.common_unit, self.uncommon = re.compile(COMMON_UNIT), re.compile(UNCOMMON)
        self.white = regex.compile(r"\s*")
        self.apart: dict = {}
        self.units: dict[str, bytes] = {}

    def stays_apart(self, a: bytes, b: bytes) -> bool:
        """Whether the bytes of two tokens, merged on their own, give these two tokens again; kept in ``apart``.

        The merges that made both are undone, latest first; at each step the two pieces that then met at the border must
        not have had a merge that was due earlier than the one undone.
        """
        left, right, due, fits = a, b, 1 << 60, True
        while fits:
            (ra, _, left_end), (rb, right_begin, _) = self.made[left], self.made[right]
            if self.rank.get((left, right), 1 << 60) < due:
                fits = False
            elif ra < 0 and rb < 0:
                break
            elif ra > rb:
                due, left = ra, left_end
            else:  # of merges of one kind, the one on the left came first
                due, right = rb + 1, right_begin
        if len(self.apart) > CACHE_ENTRIES:
            self.apart.clear()
        self.apart[a, b] = fits
        return fits

    def piece(self, text: str) -> list[int]:
        """Counts for all character prefixes of one pre-token."""
        raw = text.encode()
        n = len(raw)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        ids, known = self.ids, self.apart.get
        for end in range(1, n + 1):
            for begin in range(end - 1, max(0, end - self.longest) - 1, -1):  # exactly one token fits; most are short
                token = raw[begin:end]
                if token in ids:
                    if begin:
                        fits = known((last[begin], token))
                        if fits is None:
                            fits = self.stays_apart(last[begin], token)
                        if not fits:
                            continue
                    count[end], last[end] = count[begin] + 1, token
                    break
        if n == len(text):
            return count[1:]
        out, at = [], 0
        for c in text:
            at += len(c.encode())
            out.append(count[at])
        return out

    def deltas(self, unit: str) -> bytes:
        if unit[unit[0] == " ":].isalpha() or self.plain.fullmatch(unit):
            counts = self.piece(unit)
        elif unit[0].isspace() and unit[0] != " " and unit[1:].isalpha():  # as after a line end
            head = self.whole(unit[0])
            counts = [head, *(head + k for k in self.piece(unit[1:]))]
        else:
            counts = self.growing(unit)
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def growing(self, unit: str) -> list[int]:
        """Counts for all prefixes of white space and a run, each read once.

        While it grows, white space is one piece. Once a character follows, its last character stands alone or, if it is a space, belongs to the run; from then on
        all pieces but the last are fixed, and the last one grows by characters of its own kind. Only a contraction is a different cut while incomplete.
        """
        white = self.white.match(unit).end()
        counts = self.piece(unit[:white]) if white else []
        if white == len(unit):
            return counts
        joins = unit[:white].endswith(" ")
        fixed = self.piece(unit[:white - 1])[-1] if white > 1 else 0
        if white and not joins:
            fixed += self.piece(unit[white - 1])[-1]
        run = []
        for piece in self.split.findall(unit[white - joins:]):
            short = piece[0] == "'" and len(piece) <= 3
            part = [self.whole(piece[:k]) for k in range(1, len(piece) + 1)] if short else self.piece(piece)
            run += [fixed + k for k in part]
            fixed += part[-1]
        return counts + run[joins:]

    def whole(self, text: str) -> int:
        if self.plain.fullmatch(text):
            return self.piece(text)[-1]
        return sum(self.piece(p)[-1] for p in self.split.findall(text))

    def table(self, text: str) -> bytes:
        """The prefix table of a text: one signed byte per character. An added token is plain text until its last character, which makes it one token."""
        out, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            before = m.start() - at
            part = self.table_plain(text[at:m.end()])[:-1]
            steps = np.frombuffer(part, np.int8)
            out += [part, bytes([(1 - int(steps[before:].sum(dtype=np.int64))) & 255])]
            at = m.end()
        return b"".join([*out, self.table_plain(text[at:])])

    def table_plain(self, text: str) -> bytes:
        units = (self.unit if self.uncommon.search(text) else self.common_unit).findall(text)
        get = self.units.get
        parts = list(map(get, units))
        if None in parts:
            for k, x in enumerate(parts):
                if x is None:
                    known = self.units.get(units[k])
                    if known is None:
                        known = self.deltas(units[k])
                        if len(units[k]) <= 64:
                            if len(self.units) >= CACHE_ENTRIES:
                                self.units.clear()
                            self.units[units[k]] = known
                    parts[k] = known
        return b"".join(parts)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def counts_of(table: bytes) -> np.ndarray:
    """Token count of every prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)])


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(table) <= budget)[-1])


def prefix_tables(df: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT,
                  keep_table: bool = True) -> DataFrame:
    """(key, n_bytes, n_tokens, cut_chars[, prefix_deltas]) per row, in one narrow pass.

    ``cut_chars`` is the longest prefix within ``limit`` tokens. Other columns of ``df`` are not read. The vocabulary (a few MB,
    fixed by its publisher) is read by the driver and travels with the task.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batch: pa.RecordBatch) -> list:
        counter = worker_cache(f"prefix_counter_{vocabulary.value.__hash__()}", lambda: PrefixCounter(vocabulary.value))
        size, total, cut, tables = [], [], [], []
        for t in batch.column(1).to_pylist():
            table = counter.table(t) if t else b""
            n = int(np.frombuffer(table, np.int8).sum(dtype=np.int64))
            size.append(len(t.encode()) if t else 0)
            total.append(n)
            # most prefixes of a text below the limit are below it too, but the last one may not be the largest
            cut.append(len(table) if n <= limit else longest_prefix(table, limit))
            if keep_table:
                tables.append(table)
        return [batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(cut, pa.int64()),
                *([pa.array(tables, pa.binary())] if keep_table else [])]

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), count, f"{key} {kind}, n_bytes bigint, n_tokens bigint, cut_chars bigint"
                       + ", prefix_deltas binary" * keep_table)


@query("op1_token_counts")
def op1_token_counts(spark, folder):
    """Token counts of all whole documents, with the cut for the limit from the same prefix table."""
    t = prefix_tables(scan(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_table=False)
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "cut_chars")
