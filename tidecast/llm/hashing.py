"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2 ** 64 - 1], np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]
    text = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return text[at[0]:at[-1]], at - at[0]


def word_spans(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each row (one more entry than rows)."""
    n = len(text)
    inside = ~SPACE[text]
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:] = inside
    after[:n] = inside
    before[at] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, eight bytes at a time for all spans together."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text) + 1,), "<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * ODD[0]
    live, k = np.arange(len(starts)), 0
    while live.size:
        rest = length[live] - k
        x = h[live] ^ (eights[starts[live] + k] & KEEP[np.minimum(rest, 8)])
        x *= ODD[1]
        h[live] = x ^ (x >> np.uint64(32))
        live, k = live[rest > 8], k + 8
    return mixed(h)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and the number of the first word of each row."""
    text, at = utf8(column)
    text = LOWER[text]
    starts, ends, first = word_spans(text, at)
    return span_hashes(text, starts, ends), first


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (``size`` at most 5)."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out += h[k:len(h) - size + 1 + k] * ODD[k]
    return mixed(out)
