"""Golomb-Rice codes of sorted integers, written and read with numpy."""

from __future__ import annotations

import numpy as np


def parameter(count: int, span: int) -> int:
    """Low bits that suit `count` values spread over `span`."""
    return max(0, int(np.log2(max(1.0, span / max(1, count)) * 0.69)) if span else 0)


def encode(values: np.ndarray, low: int) -> bytes:
    """Sorted non-negative integers as gaps: each gap's high part in unary, its `low` lowest bits in binary."""
    if not len(values):
        return b""
    gaps = np.diff(np.asarray(values, np.uint64), prepend=np.uint64(0))
    high = (gaps >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(low - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((len(gaps), 0), np.uint8)
    return np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def decode(data: bytes, count: int, low: int) -> np.ndarray:
    """The values of encode(values, low); count says how many."""
    if not count:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits)[:count]
    high = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1 : ends[-1] + 1 + count * low].reshape(count, low).astype(np.uint64)
    lower = rest @ (np.uint64(1) << np.arange(low - 1, -1, -1, dtype=np.uint64)) if low else np.zeros(count, np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(low)) + lower.astype(np.uint64), dtype=np.uint64)
