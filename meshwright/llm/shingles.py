"""Word shingles of whole batches of texts as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meshwright.llm import common

_BASE = 0xD6E8FEB86659FD93
_MIX = np.uint64(0x9FB21C651E98DF25)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
#: Bytes of text for one vectorised step; a longer text is a step of its own.
STEP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """shingles(texts) -> (hash of each shingle, number of shingles of each text).

    Words are runs of ASCII letters, digits, underscores and non-ASCII characters, lower case. A text with fewer words than `words` has one
    shingle of them all; a text without words has none.
    """

    def __init__(self, words: int = 5):
        self.words = words
        self.powers, self.inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.random = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = common.utf8(pc.utf8_lower(column))
        data, at = data[at[0] : at[-1]], at - at[0]
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
        if n >= len(self.powers):
            size = max(n + 1, STEP + (STEP >> 2))
            self.powers, self.inverse = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        inside = _WORD_BYTE[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.random[data] * self.powers[:n], dtype=np.uint64)])
        word = mixed((sums[ends] - sums[starts]) * self.inverse[starts])
        first = np.searchsorted(starts, at)
        words = np.diff(first)
        counts = np.where(words >= self.words, words - self.words + 1, np.minimum(words, 1))
        begin = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        left = np.repeat(first[1:], counts) - begin
        padded = np.concatenate([word, np.zeros(self.words, np.uint64)])
        out = np.zeros(len(begin), np.uint64)
        for k in range(self.words):
            out = (out + np.where(left > k, padded[begin + k], np.uint64(0))) * np.uint64(_BASE) + np.uint64(k + 1)
        return mixed(out), counts


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each text's distinct shingles ascending, how often each is there, number of distinct shingles of each text)."""
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    ordered = np.empty_like(hashes)
    for e, n in zip(ends.tolist(), counts.tolist()):
        if n:
            ordered[e - n : e] = np.sort(hashes[e - n : e])
    new = np.ones(len(hashes), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return ordered[at], np.diff(np.append(at, len(hashes))), np.bincount(owner[at], minlength=len(counts))
