"""Exact duplicates by an exchange of compressed fingerprints, then verification of the suspects' bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm import common, golomb

#: Bits of a fingerprint; more documents than about 2 ** 40 want more.
FINGERPRINT_BITS = 48
#: Rows that one packet's source holds at most.
CHUNK = 1 << 16
#: Fingerprints that one owner compares: about 32 MB in its task.
OWNED = 1 << 22
#: Keys over which the rows of one text are dealt.
SALT = 16


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def _digest(body: str) -> Column:
    return F.unhex(F.sha2(F.col(body).cast("binary"), 256))


def _prints(sha: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints of rows of 32 bytes."""
    return sha[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)


def _runs(values: np.ndarray) -> np.ndarray:
    """How often each of the ascending values comes, in their order."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    return np.diff(np.append(starts, len(values)))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n).astype(bool)


_SENT = "source long, owner int, n long, low int, prints binary, here binary, doc_ids array<long>, hashes binary"
_SENT_ARROW = pa.schema(
    [("source", pa.int64()), ("owner", pa.int32()), ("n", pa.int64()), ("low", pa.int32()), ("prints", pa.binary())]
    + [("here", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.binary())]
)


def _send(owners: int, bits: int):
    span = (1 << bits) // owners + 1

    def packets(held: list[pa.RecordBatch], source: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sha = np.frombuffer(b"".join(table["sha"].to_pylist()), np.uint8).reshape(-1, 32)
        prints = _prints(sha, bits)
        order = np.argsort(prints, kind="stable")
        prints, sha, names = prints[order], sha[order], table["doc_id"].combine_chunks().take(pa.array(order))
        cuts = np.searchsorted(prints, np.arange(owners + 1, dtype=np.uint64) * np.uint64(span))
        out = {name: [] for name in _SENT_ARROW.names}
        for owner in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[owner], cuts[owner + 1]
            times = _runs(prints[i:j])
            once = prints[i:j][np.cumsum(times) - times] - np.uint64(owner * span)
            low = golomb.parameter(len(once), span)
            row = (source, int(owner), len(once), low, golomb.encode(once, low), _bits(times > 1))
            for k, v in zip(out, (*row, names.slice(i, j - i).to_pylist(), sha[i:j].tobytes())):
                out[k].append(v)
        return pa.RecordBatch.from_pydict(out, schema=_SENT_ARROW)

    def send(batches):
        """Sorted packets for each owner: Golomb-coded fingerprints, each once with a bit that says whether it is there more than
        once; and what stays home, ids and hashes in that order."""
        from pyspark import TaskContext

        source, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                yield packets(held, source)
                source, held, rows = source + 1, [], 0
        if rows:
            yield packets(held, source)

    return send


def _answer(packets: pd.DataFrame) -> pd.DataFrame:
    """For each packet that an owner got, a bitmap of the fingerprints that it has seen more than once."""
    values = [golomb.decode(p, n, low) for p, n, low in zip(packets["prints"], packets["n"], packets["low"])]
    here = np.concatenate([_unbits(b, n) for b, n in zip(packets["here"], packets["n"])])
    _, inverse, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    twice = np.split((count[inverse] > 1) | here, np.cumsum(packets["n"])[:-1])
    return pd.DataFrame({"source": packets["source"], "owner": packets["owner"], "bitmap": [_bits(t) for t in twice]})


def _telling(bits: int):
    def tell(batches):
        """Each packet's rows with the bit of their fingerprint."""
        for batch in batches:
            for names, hashes, bitmap in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "hashes", "bitmap"))):
                sha = np.frombuffer(hashes, np.uint8).reshape(-1, 32)
                times = _runs(_prints(sha, bits))
                suspect = np.repeat(_unbits(bitmap, len(times)), times)
                columns = [pa.array(names, pa.int64()), pa.array([row.tobytes() for row in sha], pa.binary()), pa.array(suspect)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "suspect"])

    return tell


def _at_home(sent: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each packet's ids and hashes with its bitmap: only bitmaps travel, all those of a source together, to where its rows lie."""
    answers = bitmaps.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("owner", "bitmap"))).alias("answers"))
    home = sent.select("source", "owner", "doc_ids", "hashes").join(answers, "source")
    return home.select("doc_ids", "hashes", F.col("answers")[F.col("owner")].alias("bitmap"))


def find_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """Groups docs(doc_id long, text string) whose texts are equal after each run of white space became one space.

    One row for each input row: doc_id, keep_id (the group's smallest doc_id), group_size, kept, text_sha256.

    Each source chunk sends every owner (a range of fingerprints) its sorted, Golomb-coded fingerprints and gets back a bitmap
    of those that some source, itself included, holds more than once. Ids and hashes stay in a table bucketed by source, which the
    bitmaps come to. Only texts of rows so marked are read again and
    shuffled, and grouped by their bytes; a fingerprint that merely collides ends in a group of one, and texts that share a sha256 are
    classes apart. Counts and minima are
    taken before the shuffle, so that a text that a third of all rows share is no hot spot. `owners` is the number
    of shuffle partitions unless given, or more, so that none has over about OWNED fingerprints. Very long texts are hashed and compared whole.

    Nulls: a null text equals the empty text. A null doc_id is kept only where its group has no other; of repeated rows with the
    smallest id one is kept. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    packets = rows.select("doc_id", _digest("body").alias("sha")).mapInArrow(_send(owners, FINGERPRINT_BITS), _SENT)
    with common.bucketed(packets, "source") as sent:
        prints = sent.select("source", "owner", "n", "low", "prints", "here")
        bitmaps = prints.groupBy("owner").applyInPandas(_answer, "source long, owner int, bitmap binary")
        told = _at_home(sent, bitmaps).mapInArrow(_telling(FINGERPRINT_BITS), "doc_id long, sha binary, suspect boolean")
        told = common.checkpoint(told)
    suspects = told.filter("suspect")

    # the suspects' bytes, grouped before they are shuffled; rows that the id filter lets through beside them are groups of their own
    _, near = common.split_by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), suspects.select("doc_id"))
    texts = near.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("sha", _digest("body"))
    groups = texts.groupBy("sha", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = groups.groupBy("sha").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    classes = common.checkpoint(classes)
    # rows of one text meet its class under SALT keys
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")
    single = classes.filter("texts = 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = suspects.select("doc_id", "sha", dealt.alias("salt")).join(single, ["sha", "salt"]).withColumn("class", F.lit(""))
    clashes = classes.filter("texts > 1").select("sha")
    if not clashes.isEmpty():
        # several texts of one hash: their rows take their classes by the bytes
        apart = texts.join(clashes, "sha", "left_semi").join(groups, ["sha", "body"]).withColumnRenamed("body", "class")
        found = found.select("sha", "doc_id", "class", "keep_id", "group_size").unionByName(apart)
    twins = Window.partitionBy("sha", "class", "doc_id").orderBy(F.lit(1))
    # only the smallest id of a class can be there twice and kept
    is_first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = found.filter(is_first).withColumn("kept", F.row_number().over(twins) == 1)
    others = found.filter(~is_first).withColumn("kept", F.lit(False))
    columns = ["doc_id", "sha", "keep_id", "group_size", "kept"]
    alone = told.filter("not suspect").select(
        "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    out = alone.unionByName(first.select(*columns)).unionByName(others.select(*columns))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
