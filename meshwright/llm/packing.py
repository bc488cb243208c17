"""Bounded-space online packing of token ids into sequences of fixed length."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import common
from meshwright.llm.tokens import BatchEncoder

#: Parts whose leftovers are merged by one task.
_FAN_IN = 64


class Windows:
    """A fixed number of open windows. add() places a piece best-fit; with none that fits and all in use, the fullest goes.

    If the fullest window lacks at least min_cut tokens, the piece's head fills it before it goes; a smaller gap is left as
    padding. A piece is (doc_id, start, ids, doc_tokens). out: closed windows, lists of pieces.
    """

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.gaps: list[int] = []
        self.open: list[list] = []
        self.out: list[list] = []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.out.append([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            n = len(ids)
            fit = min((g for g in self.gaps if g >= n), default=0)
            if fit:
                return self._put(self.gaps.index(fit), doc, start, ids, total)
            if len(self.gaps) < self.most:
                self.gaps.append(self.size)
                self.open.append([])
                return self._put(len(self.gaps) - 1, doc, start, ids, total)
            gap = min(self.gaps)
            k = self.gaps.index(gap)
            if gap >= self.min_cut:
                self._put(k, doc, start, ids[:gap], total)
                start, ids = start + gap, ids[gap:]
            else:
                self._close(k)

    def _put(self, k: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.open[k].append((doc, start, ids, total))
        self.gaps[k] -= len(ids)
        if not self.gaps[k]:
            self._close(k)

    def _close(self, k: int) -> None:
        self.out.append(self.open.pop(k))
        self.gaps.pop(k)

    def finish(self) -> None:
        """Everything that is open goes, fullest first, each filled from the emptiest."""
        pieces = [p for w in sorted(self.open, key=lambda w: -sum(len(p[2]) for p in w)) for p in w]
        self.gaps, self.open, self.most, self.min_cut = [], [], 1, 1
        for p in pieces:
            self.add(*p)
        while self.open:
            self._close(0)


_NUMBERS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_COLUMNS = ", ".join(f"{c} long" for c in _NUMBERS)
_STATE = _COLUMNS + ", ids binary, part int, closed boolean"
_ARROW = pa.schema([*((c, pa.int64()) for c in _NUMBERS), ("ids", pa.binary()), ("part", pa.int32()), ("closed", pa.bool_())])


def _rows(windows: list[list], first: int, closed: bool, ids_too: bool, part: int) -> pa.Table:
    """A row for each piece; ids of documents stay whole numbers, as no null turns an Arrow column into floats."""
    out = {c: [] for c in (*_NUMBERS, "ids")}
    for k, window in enumerate(windows):
        at = 0
        for doc, start, ids, total in window:
            data = ids.astype("<u4").tobytes()
            row = (doc, start, len(ids), zlib.crc32(data), total, first + k, at, data if ids_too or not closed else None)
            for name, value in zip(out, row):
                out[name].append(value)
            at += len(ids)
    n = len(out["doc_id"])
    return pa.Table.from_pydict(out | {"part": [part] * n, "closed": [closed] * n}, _ARROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, open_windows: int = 16, min_cut: int = 16, include_ids: bool = False) -> DataFrame:
    """Packs docs(doc_id long, text string) into sequences of `length` ids at most; one row for each piece of a document.

    A document is its token ids and end_id; it is cut only where it fills a sequence. Returns doc_id, start (the
    document's ids before the piece), length, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset (the piece's place there, without gaps from 0) and, if asked for, ids (those bytes).

    Each input partition keeps `open_windows` open windows. When none fits, the fullest goes: filled by the head of the piece
    if it lacks min_cut ids or more, else padded by fewer than that. What is open at a partition's end is merged, 64
    partitions to a task, again with open windows, until one task ends the last few; so only ids of open
    windows (at most open_windows * length for each partition) move between tasks, never texts.

    Nulls: a null text is empty, its document is end_id alone; null and repeated ids are packed as any other row. Very long
    texts: whole sequences are cut off one after another. Empty table: no rows. Other columns are ignored.
    """

    def first(batches):
        from pyspark import TaskContext

        part, encoder, made = TaskContext.get().partitionId(), BatchEncoder.of(tokenizer_path), 0
        windows = Windows(length, open_windows, min_cut)
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for i, j in common.slices(np.diff(common.utf8(texts)[1]), 2 << 20):
                ids, counts = encoder.encode(texts.slice(i, j - i).to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end_id)
                at = 0
                for doc, n in zip(names.slice(i, j - i).to_pylist(), (counts + 1).tolist()):
                    windows.add(doc, 0, ids[at : at + n], n)
                    at += n
                # what stays open keeps its own ids, not the batch's
                windows.open = [[(d, s, x.copy(), t) for d, s, x, t in w] for w in windows.open]
                yield from _rows(windows.out, (part << 32) + made, True, include_ids, part).to_batches()
                made, windows.out = made + len(windows.out), []
        yield from _rows(windows.open, (part << 32) + made, False, True, part).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    state = common.checkpoint(rows.mapInArrow(first, _STATE))
    done = [state.filter("closed")]
    left = state.filter("not closed")
    parts = state.rdd.getNumPartitions()
    rounds = max(1, math.ceil(math.log(max(parts, 2), _FAN_IN)))
    for r in range(1, rounds + 1):
        merge = _merging(r, r == rounds, length, open_windows, min_cut, include_ids)
        met = left.withColumn("part", F.floor(F.col("part") / _FAN_IN).cast("int"))
        left = common.checkpoint(met.groupBy("part").applyInArrow(merge, _STATE))
        done.append(left.filter("closed"))
        left = left.filter("not closed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if include_ids else []))


def _merging(r: int, last: bool, length: int, most: int, min_cut: int, ids_too: bool):
    def merge(left: pa.Table) -> pa.Table:
        windows, part = Windows(length, most, min_cut), left["part"][0].as_py()
        left = left.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, total, data in zip(*(left[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            windows.add(doc, start, np.frombuffer(data, "<u4"), total)
        if last:
            windows.finish()
        first = (r << 60) + (part << 32)
        closed = _rows(windows.out, first, True, ids_too, part)
        return pa.concat_tables([closed, _rows(windows.open, first + len(windows.out), False, True, part)])

    return merge
