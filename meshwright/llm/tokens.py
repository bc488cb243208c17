"""Token ids of whole batches of texts under a byte-level BPE vocabulary.

The tokenizers library gives the ids. Its own pass over running text costs about a second a megabyte, most of it
not spent on merges, so texts are cut into the library's pre-tokens with numpy first, and each distinct
pre-token goes through the library's model once for each worker process. Texts with characters whose class is in
any doubt, and vocabularies with another pre-tokenizer, go through the library whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: Characters below this are classed here.
_LIMIT = 0x2100
_OTHER, _LETTER, _NUMBER, _SPACE, _DOUBT = range(5)
#: Code points for one vectorised step.
_STEP = 1 << 20
#: Distinct pre-tokens that a worker keeps.
_KEPT = 1_200_000
_BASE = 0x9E3779B97F4A7C15


def _classes() -> np.ndarray:
    out = np.full(_LIMIT, _OTHER, np.uint8)
    for i in range(_LIMIT):
        kind = unicodedata.category(chr(i))
        if kind == "Cn" or i in (0x85, 0x180E) or 0x1C <= i <= 0x1F:
            out[i] = _DOUBT
        elif kind[0] == "L":
            out[i] = _LETTER
        elif kind[0] == "N":
            out[i] = _NUMBER
        elif kind[0] == "Z" or 0x09 <= i <= 0x0D:
            out[i] = _SPACE
    return out


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class BatchEncoder:
    """encode(texts) -> (all ids, number of ids of each text), as the library's encode without special tokens."""

    _held: dict[str, BatchEncoder] = {}

    @classmethod
    def of(cls, path: str) -> BatchEncoder:
        """One for each worker process and vocabulary."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        #: Whether texts must go through the library whole.
        self.plain = not (
            self.tokenizer.normalizer is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and isinstance(self.tokenizer.model, BPE)
            and not self.tokenizer.model.dropout
            and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        self.model = self.tokenizer.model
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.letters = str.maketrans(self.letters)
        self.classes = _classes()
        self.random = np.random.default_rng(20).integers(1, 1 << 63, _LIMIT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = _powers(_BASE, _STEP + 1)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), _STEP + 1)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in _cut(text):
                pieces.append(piece)
                owner.append(i)
        ids, sizes = [], []
        for i, j in _runs([len(p) for p in pieces]):
            a, b = self._step(pieces[i:j])
            ids.append(a)
            sizes.append(b)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        counts = np.bincount(owner, np.concatenate(sizes), len(texts)).astype(np.int64)
        return np.concatenate(ids), counts

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(sizes)])
        kinds = self.classes[np.minimum(points, _LIMIT - 1)]
        doubt = (points >= _LIMIT) | (kinds == _DOUBT)
        if self.plain or len(points) > _STEP or doubt.any():
            upto = np.concatenate([[0], np.cumsum(doubt)])
            odd = (upto[at[1:]] > upto[at[:-1]]) | self.plain | (len(points) > _STEP)
            return self._mixed(texts, odd)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = self._starts(points, kinds, at)
        ends = np.append(starts[1:], len(points))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.random[points] * self.powers[: len(points)], dtype=np.uint64)])
        hashed = (sums[ends] - sums[starts]) * self.inverse[starts]
        codes, distinct = pd.factorize(hashed)
        where, size = self._known(distinct, codes, starts, ends, whole)
        size_of, where_of = size[codes].astype(np.int64), where[codes]
        total = np.cumsum(size_of)
        n = int(total[-1])
        ids = self.flat[np.repeat(where_of - (total - size_of), size_of) + np.arange(n)]
        upto = np.concatenate([[0], total])
        tokens = np.searchsorted(starts, at)
        return ids, np.diff(upto[tokens])

    def _mixed(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(odd):
            ids[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        fine = np.flatnonzero(~odd)
        if len(fine):
            a, b = self._step([texts[i] for i in fine])
            for i, x in zip(fine, np.split(a, np.cumsum(b)[:-1])):
                ids[i] = x
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _starts(self, points: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: at a change of class; the space before a word belongs to it; 's, 't, 're, 've, 'm, 'll and 'd stand alone."""
        n = len(points)
        first = np.zeros(n + 3, bool)
        first[at] = True
        opens = np.empty(n + 1, bool)
        opens[1:n] = kinds[1:] != kinds[:-1]
        opens[first[: n + 1]] = True
        last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~first[1:n])
        opens[last] = True
        opens[last[points[last] == 0x20] + 1] = False
        marks = np.flatnonzero(points == 0x27)
        if len(marks):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            letter = np.concatenate([kinds == _LETTER, np.zeros(3, bool)])
            same = [~first[marks + 1], ~(first[marks + 1] | first[marks + 2])]
            before_ok = first[marks] | ((kinds[marks - 1] != _OTHER) & (points[marks - 1] != 0x20))
            one, two = padded[marks + 1], padded[marks + 2]
            short = np.isin(one, [ord(c) for c in "stmd"]) & same[0]
            pair = np.zeros(len(marks), bool)
            for a, b in ("re", "ve", "ll"):
                pair |= (one == ord(a)) & (two == ord(b))
            pair &= same[1]
            ok = before_ok & (short | pair) & letter[marks + 1]
            opens[marks[ok] + 1] = False
            opens[marks[ok] + np.where(short[ok], 2, 3)] = True
        return np.flatnonzero(opens[:n])

    def _known(self, distinct: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each distinct pre-token lie in self.flat, and how many there are."""
        if len(self.keys) > _KEPT:
            self._forget()
        order = np.argsort(distinct)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ordered = distinct[order]
        place = np.searchsorted(self.keys, ordered)
        new = self.keys[np.minimum(place, len(self.keys) - 1)] != ordered if len(self.keys) else np.ones(len(ordered), bool)
        if new.any():
            example = np.empty(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            tokens = example[order[new]]
            found = [[t.id for t in x] for x in map(self.model.tokenize, self._spelled([whole[s:e] for s, e in zip(starts[tokens].tolist(), ends[tokens].tolist())]))]
            size = np.array([len(x) for x in found], np.int32)
            where = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate([self.flat, np.array([i for x in found for i in x], np.uint32)])
            into = place[new]
            self.keys, self.at, self.sizes = (np.insert(a, into, b) for a, b in ((self.keys, ordered[new]), (self.at, where), (self.sizes, size)))
            place = np.searchsorted(self.keys, ordered)
        return self.at[place][rank], self.sizes[place][rank]

    def _spelled(self, pieces: list[str]) -> list[str]:
        """Each piece's UTF-8 bytes as the vocabulary's letters."""
        spell = lambda text: text.encode().decode("latin-1").translate(self.letters)
        joined = "\0".join(pieces)
        return spell(joined).split(spell("\0")) if joined.count("\0") == len(pieces) - 1 else [spell(x) for x in pieces]


def _cut(text: str):
    """A long text in parts: before a space between two letters a pre-token always starts."""
    while len(text) > _STEP:
        at = _STEP
        while at > 1 and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at = text.rfind(" ", 1, at)
        if at <= 1:
            break
        yield text[:at]
        text = text[at:]
    yield text


def _runs(sizes: list[int]):
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > _STEP:
            yield i, j
            i, total = j, 0
        total += n
    if len(sizes) > i:
        yield i, len(sizes)
