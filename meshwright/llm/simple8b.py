"""Token ids on disk in Simple-8b: a selector in the top 4 bits of a 64-bit word says how many ids of which width follow.

Selectors 1 to 14 hold 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of equal width. Selector 15 escapes a
value over 60 bits, which fills the next word. Every BLOCK ids start a new word whose offset is kept, so that all
blocks are coded and decoded side by side with numpy.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm import common
from meshwright.llm.tokens import BatchEncoder

#: (ids in a word, bits of each) of selectors 1 to 14.
LAYOUTS = [(n, 60 // n) for n in (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)]
ESCAPE = 15
BLOCK = 1024
_HEAD = struct.Struct("<4sIQQQ")
_MAGIC = b"s8b1"
#: Ids of a segment (one row of a file); a longer document is a segment of its own.
SEGMENT = 1 << 20


def _widths(ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = (ids >> np.uint64(shift)) > 0
        out += (high * shift).astype(np.uint8)
        ids = np.where(high, ids >> np.uint64(shift), ids)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word and of the end) of ids, as unsigned 64-bit integers."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    widths = _widths(ids)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))
    selector = np.full(n, ESCAPE, np.uint8)
    for k in range(len(LAYOUTS), 0, -1):
        count, bits = LAYOUTS[k - 1]
        wide = np.flatnonzero(widths > bits)
        if len(wide) == n:
            break
        to = np.full(n, n, np.int32)
        to[wide] = wide
        to = np.minimum.accumulate(to[::-1])[::-1] - np.arange(n, dtype=np.int32)
        selector[(to >= count) & (left >= count)] = k
    step = np.array([0, *(c for c, _ in LAYOUTS), 1])[selector]
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    used, blocks = [], np.arange(len(at))
    while len(blocks):
        used.append(at[blocks])
        at[blocks] += step[at[blocks]]
        blocks = blocks[at[blocks] < end[blocks]]
    starts = np.sort(np.concatenate(used))
    chosen = selector[starts]
    place = np.arange(len(starts)) + np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), np.uint64)
    for k, (count, bits) in enumerate(LAYOUTS, 1):
        mine = chosen == k
        if mine.any():
            values = ids[starts[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[mine]] = np.bitwise_or.reduce(values, axis=1) | np.uint64(k << 60)
    over = place[chosen == ESCAPE]
    words[over] = np.uint64(ESCAPE << 60)
    words[over + 1] = ids[starts[chosen == ESCAPE]]
    offsets = np.append(place[np.searchsorted(starts, np.arange(0, n, BLOCK))], len(words))
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids of encode(ids)."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    count = np.array([0, *(c for c, _ in LAYOUTS), 1])[selector]
    if (selector == ESCAPE).any():
        # a raw word may look like any selector; only blocks that hold a 15 anywhere are walked word by word
        sums = np.concatenate([[0], np.cumsum(selector == ESCAPE)])
        for b in np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]]):
            i = int(offsets[b])
            while i < offsets[b + 1]:
                if selector[i] == ESCAPE:
                    selector[i + 1], count[i + 1] = 0, 0
                    i += 1
                i += 1
    to = np.cumsum(count)
    out = np.zeros(int(to[-1]), np.uint64)
    for k, (n, bits) in enumerate(LAYOUTS, 1):
        mine = np.flatnonzero(selector == k)
        if len(mine):
            shifts = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            out[(to[mine] - n)[:, None] + np.arange(n)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    over = np.flatnonzero(selector == ESCAPE)
    out[to[over] - 1] = words[over + 1]
    return out


def pack_segment(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """Header, ids of each document, block offsets, words; all little-endian."""
    words, offsets = encode(ids)
    return b"".join([_HEAD.pack(_MAGIC, BLOCK, len(sizes), len(ids), len(words)), np.asarray(sizes, "<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of pack_segment."""
    magic, block, docs, n, n_words = _HEAD.unpack_from(blob)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a Simple-8b segment of this format")
    at = _HEAD.size
    sizes = np.frombuffer(blob, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    blocks = -(-n // BLOCK) + 1
    offsets = np.frombuffer(blob, "<u4", blocks, at).astype(np.int64)
    ids = decode(np.frombuffer(blob, "<u8", n_words, at + 4 * blocks).astype(np.uint64), offsets)
    if len(ids) != n:
        raise ValueError("a Simple-8b segment is damaged")
    return ids, sizes


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Writes the token ids of docs(doc_id long, text string), each document ended by end_id, in ascending doc_id order.

    The files lie under `path` as Parquet that holds one Simple-8b segment (about SEGMENT ids) a row: part, segment,
    n_ids, doc_ids, payload. Order: part, segment, place in the segment. Null ids come first, rows with one id
    in the order of their texts' hash, so that they may lie in several parts; a null text is empty, so it has the end id alone. An empty table gives files
    without rows. Other columns are ignored.

    One range shuffle of the texts puts them in order; the ids themselves are never shuffled. The write is a plain
    Spark job, so a lost executor's files are written again by another.
    """
    schema = "part int, segment int, n_ids long, doc_ids array<long>, payload binary"

    def write(batches):
        from pyspark import TaskContext

        part, encoder, segment = TaskContext.get().partitionId(), BatchEncoder.of(tokenizer_path), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        total = 0

        def flush():
            nonlocal held, total, segment
            ids, sizes, names = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]]
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())), "payload": pa.array([pack_segment(ids, sizes)], pa.binary())})
            held, total, segment = [], 0, segment + 1
            return out

        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            lengths = np.diff(common.utf8(texts)[1])
            for i, j in common.slices(lengths, 2 << 20):
                ids, counts = encoder.encode(texts.slice(i, j - i).to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                held.append((ids, counts + 1, names.slice(i, j - i).to_pylist()))
                total += len(ids)
                if total >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    # rows of one id, or even of one id and text, are cut by what follows
    order = ["doc_id", F.xxhash64("text"), "place"]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.drop("place").mapInArrow(write, schema).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents that write_ids wrote: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema("part int, segment int, n_ids long, doc_ids array<long>, payload binary").parquet(path)
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n_ids"))
    inside = sizes.withColumn("before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    # one row for each part file: as many as the shuffle has partitions
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    starts = inside.join(F.broadcast(parts.select("part", "first")), "part").select("part", "segment", (F.col("first") + F.col("before")).alias("base"))

    def read(batches):
        for batch in batches:
            for part, segment, names, payload in zip(*(batch.column(c) for c in ("part", "segment", "doc_ids", "payload"))):
                ids, counts = unpack_segment(payload.as_py())
                ends = np.cumsum(counts)
                ids = ids.astype("<u4")
                each = [ids[e - n : e] for e, n in zip(ends, counts)]
                columns = {"doc_id": pa.array(names.as_py(), pa.int64()), "part": pa.array([part.as_py()] * len(ends), pa.int32()), "segment": pa.array([segment.as_py()] * len(ends), pa.int32()), "within": pa.array(ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(list(each), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, part int, segment int, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = files.select("part", "segment", "doc_ids", "payload").mapInArrow(read, schema)
    extra = ["ids"] if with_ids else []
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *extra)
