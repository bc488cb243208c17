"""A small convolutional network over bytes, trained and run with numpy."""

from __future__ import annotations

import numpy as np

#: Windows that go through the network at once.
_ROWS = 96


def windows(data: np.ndarray, offsets: np.ndarray, size: int, overlap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end of text, text's number) of windows that cover every text whole.

    Neighbours share `overlap` bytes; the last of a longer text ends with it (and so may share more); a text no longer than
    `size`, also an empty one, has one.
    """
    lengths = np.diff(offsets)
    step = size - overlap
    count = np.maximum(1, -(-(lengths - overlap) // step))
    owner = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(number * step, np.maximum(lengths[owner] - size, 0)) + offsets[owner]
    return start, offsets[owner + 1], owner


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The windows' bytes, zeros beyond a text's end."""
    at = start[:, None] + np.arange(size)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)


class ByteConvNet:
    """Filters of several widths, max-pooled over a window, then a hidden layer and one output for each class."""

    def __init__(self, filters: dict[int, int], hidden: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = filters
        f = sum(filters.values())
        self.p = {f"t{w}": rng.normal(0, 1 / np.sqrt(w), (w, 256, n)).astype(np.float32) for w, n in filters.items()}
        self.p |= {"b": np.zeros(f, np.float32), "w1": rng.normal(0, np.sqrt(2 / f), (f, hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32), "w2": rng.normal(0, np.sqrt(1 / hidden), (hidden, classes)).astype(np.float32), "b2": np.zeros(classes, np.float32)}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        out, where = [], {}
        for w in self.filters:
            t, m = self.p[f"t{w}"], x.shape[1] - w + 1
            z = t[0][x[:, :m]]
            for k in range(1, w):
                z += t[k][x[:, k : k + m]]
            where[w] = z.argmax(1)
            out.append(np.take_along_axis(z, where[w][:, None], 1)[:, 0])
        return np.concatenate(out, 1), where

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteConvNet:
        """Softmax cross-entropy by Adam; rows are drawn by weight."""
        rng = np.random.default_rng(seed)
        share = np.cumsum(weight / weight.sum())
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = np.minimum(np.searchsorted(share, rng.random(batch)), len(x) - 1)
            bx, by = x[rows], y[rows]
            top, where = self._pooled(bx)
            a = np.maximum(top + self.p["b"], 0)
            h = np.maximum(a @ self.p["w1"] + self.p["b1"], 0)
            z = h @ self.p["w2"] + self.p["b2"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(batch), by] -= 1
            q /= batch
            g = {"w2": h.T @ q, "b2": q.sum(0)}
            dh = (q @ self.p["w2"].T) * (h > 0)
            g |= {"w1": a.T @ dh, "b1": dh.sum(0)}
            da = (dh @ self.p["w1"].T) * (a > 0)
            g["b"] = da.sum(0)
            first = 0
            for w, n in self.filters.items():
                gt, d = np.zeros_like(self.p[f"t{w}"]), da[:, first : first + n]
                for k in range(w):
                    codes = bx[np.arange(batch)[:, None], where[w] + k].astype(np.int64) * n + np.arange(n)
                    gt[k] = np.bincount(codes.ravel(), d.ravel(), 256 * n).reshape(256, n)
                g[f"t{w}"] = gt
                first += n
            scale = rate * (0.1 + 0.9 * (1 - step / steps))
            for k, grad in g.items():
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                self.p[k] -= scale * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def frozen(self) -> FrozenNet:
        return FrozenNet(self.filters, {k: v.astype(np.float32) for k, v in self.p.items()})


class FrozenNet:
    """The trained network; sums of two neighbouring taps are looked up by pairs of bytes."""

    def __init__(self, filters: dict[int, int], p: dict[str, np.ndarray]):
        self.filters, self.p, self.pairs = filters, p, None

    def __getstate__(self):
        return self.filters, self.p

    def __setstate__(self, state):
        (self.filters, self.p), self.pairs = state, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Outputs for windows (rows of bytes)."""
        if self.pairs is None:
            self.pairs = {w: [(self.p[f"t{w}"][k][None, :, :] + self.p[f"t{w}"][k + 1][:, None, :]).reshape(65536, n) for k in range(0, w - 1, 2)] for w, n in self.filters.items()}
        out = np.empty((len(x), self.p["w2"].shape[1]), np.float32)
        for i in range(0, len(x), _ROWS):
            b = x[i : i + _ROWS]
            pair = b[:, :-1].astype(np.int32) | (b[:, 1:].astype(np.int32) << 8)
            tops = []
            for w in self.filters:
                m = x.shape[1] - w + 1
                z = self.pairs[w][0].take(pair[:, :m], 0)
                for k, table in enumerate(self.pairs[w][1:], 1):
                    z += table.take(pair[:, 2 * k : 2 * k + m], 0)
                if w % 2:
                    z += self.p[f"t{w}"][w - 1].take(b[:, w - 1 : w - 1 + m], 0)
                tops.append(z.max(1))
            h = np.maximum(np.maximum(np.concatenate(tops, 1) + self.p["b"], 0) @ self.p["w1"] + self.p["b1"], 0)
            out[i : i + _ROWS] = h @ self.p["w2"] + self.p["b2"]
        return out
