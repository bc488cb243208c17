"""What several corpus operators share: checkpoints, id filters, batch helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.plans.materialise import checkpoint, remove, scratch_path  # noqa: F401

#: White space of every contract here: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str, parts: int, left_out: int) -> Column:
    """Whether crc32 of the id as text, modulo parts, is left_out (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == left_out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: More buckets than these are refused by Spark's default settings.
MOST_BUCKETS = 100_000


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df as a table bucketed by key: while the block runs, joins on the key leave its rows where they are.

    Its files lie in the folder that executors share, not in the warehouse, which by default is one machine's. Table and files are dropped at the end
    of the block, so what is made of them must be written or checkpointed there.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = scratch_path(spark, "bucketed")
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)


#: A table of this many rows at most goes to every task; beyond it the other side's rows are dealt over SALT keys.
MOST_SENT, SALT = 1 << 16, 64


def beside(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """rows (r) joined with a table (s) of one row for each value of a column, nulls with nulls.

    The table is broadcast only if it was counted to be small; else a value that many rows share meets it under SALT keys.
    """
    same = F.col(f"r.{column}").eqNullSafe(F.col(f"s.{column}"))
    if table.count() <= MOST_SENT:
        return rows.alias("r").join(F.broadcast(table.alias("s")), same)
    (salt,) = fresh(rows, "_salt")
    dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).alias("r")
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).alias("s")
    return dealt.join(copies, same & (F.col(f"r.{salt}") == F.col(f"s.{salt}")))


#: Bits of an id filter for each id, and in all (at 64 bits a row, 2**21 rows are broadcast at most).
BITS_EACH, MOST_BITS = 16, 1 << 27


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs whose key can't be in ids, and the rest: one in 16 of the others beside those that are.

    The filter is a bitmap of hashes, its rows words of 64 bits; its size follows the number of ids up to MOST_BITS. Of more ids than that
    it would pass nearly all rows: then all are the rest. What follows must tell them apart itself, and shuffles little more
    than the rows that match.
    """
    n = ids.count()
    if n > MOST_BITS:
        return docs.limit(0), docs
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * n).bit_length()))
    word, mask, filled = fresh(docs, "_word", "_mask", "_filled")
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    own = [F.shiftright(place, 6).alias(word), F.expr("shiftleft(1L, cast(%s as int))" % mask).alias(mask)]
    put = lambda df: df.withColumn(mask, F.pmod(place, F.lit(64)))
    words = put(ids.select(key)).select(*own).groupBy(word).agg(F.bit_or(mask).alias(filled))
    tagged = put(docs).withColumns({word: own[0], mask: own[1]}).alias("d")
    words = F.broadcast(words.alias("f"))
    hit = (F.col(f"d.{word}") == F.col(f"f.{word}")) & (F.col(f"d.{mask}").bitwiseAND(F.col(f"f.{filled}")) != 0)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    return tuple(tagged.join(words, hit, kind).select(*columns) for kind in ("left_anti", "left_semi"))


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in ids (nulls match nulls); texts of other rows aren't shuffled."""
    (name,) = fresh(docs, "_key")
    _, near = split_by_ids(docs, ids, key)
    keys = ids.select(F.col(key).alias(name)).distinct()
    return near.join(keys, F.col(key).eqNullSafe(F.col(name)), "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key isn't in ids (nulls match nulls); few texts are shuffled."""
    (name,) = fresh(docs, "_key")
    far, near = split_by_ids(docs, ids, key)
    keys = ids.select(F.col(key).alias(name)).distinct()
    return far.unionByName(near.join(keys, F.col(key).eqNullSafe(F.col(name)), "left_anti"))


def slices(lengths: np.ndarray, most: int):
    """(from, to) of runs of items whose lengths sum to `most` at most, or of one longer item."""
    ends = np.cumsum(lengths)
    i = 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield i, j
        i = j


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offset of each text and of the end."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at
