"""Turning edges round, and following those that few nodes share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.plans.materialise import checkpoint, dealt

#: Rows of a key, of either side, that meet in one group of a block join (a merge join holds 4096 as they are), and keys that are sent to all tasks.
BLOCK, KEYS = 3600, 4096


def swapped(df: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """df with the values of two columns exchanged."""
    other = {a: b, b: a}
    return df.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns))


def block_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left.join(right, on) for keys that many rows of both sides share: rows are multiplied in no task by more than a block.

    The rows of a key are dealt into blocks on either side, and each block meets each of the other side in a group of its own. What is moved is
    both sides, once for each block of the other, never what they make.
    """
    spark, on = left.sparkSession, list(on)
    blocks = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    known = checkpoint(blocks(left, "_lefts").join(blocks(right, "_rights"), on))
    keys, groups = known.agg(F.count("*"), F.coalesce(F.sum(F.col("_lefts") * F.col("_rights")), F.lit(0))).first()
    known = F.broadcast(known) if keys <= KEYS else dealt(known)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, groups)

    def laid(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = df.join(known, on).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(f"{own}s")))
        each = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
        return each.drop("_lefts", "_rights").repartition(tasks, *on, "_left", "_right")

    return laid(left, "_left", "_right").join(dealt(laid(right, "_right", "_left")), [*on, "_left", "_right"]).drop("_left", "_right")
