"""Counts, shares, rates and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.plans.materialise import checkpoint


def value_counts(df: DataFrame, column: str, keep_null: bool = False, limit: int | None = None) -> DataFrame:
    """column and n, most frequent first (ties by value)."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    out = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())
    return out.limit(limit) if limit else out


def rate(count: Column, base: Column, per: int = 10_000) -> Column:
    """Events per so many; null where the base is zero."""
    return F.try_divide(count * F.lit(float(per)), base)


def row_percent(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each column value among its row's, in percent: row, column, n, pct."""
    counted = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(row)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """Counts of low <= value < high in bins of equal width: bin (from 0), n."""
    inside = df.filter((F.col(value) >= low) & (F.col(value) < high))
    return inside.groupBy((F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)) - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: Ranges that one round of a selection counts, and rows that are put in order at its end.
RANGES, FEW = 1024, 4096


def median(df: DataFrame, value: str) -> float | None:
    """The exact median of a numeric column, without nulls and NaN: the mean of the two middle values where their number is even.

    Selection by counts: each round counts the values in RANGES equal ranges and goes on in the one that holds the middle, with its own least and greatest value, until it
    has FEW rows or one value. No task sees more than counts and a few rows, and df is read once a round.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    return (_ranked(rows, (n - 1) // 2, n, low, high) + _ranked(rows, n // 2, n, low, high)) / 2 if n % 2 == 0 else _ranked(rows, n // 2, n, low, high)


def _ranked(rows: DataFrame, rank: int, n: int, low: float, high: float) -> float:
    """The value at a place (from 0) of the n rows between low and high."""
    while low < high and n > FEW:
        here = rows.filter(F.col("v").between(low, high))
        # halves keep the difference finite
        bin_ = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * RANGES), F.lit(RANGES - 1)).alias("bin")
        counts = here.groupBy(bin_).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        if len(counts) == 1:  # nearly all of the range is empty: halve it by value
            middle = low / 2 + high / 2
            below = here.filter(F.col("v") <= middle).agg(F.count("*"), F.min("v"), F.max("v")).first()
            above = here.filter(F.col("v") > middle).agg(F.count("*"), F.min("v"), F.max("v")).first()
            counts = [c for c in ({"n": b[0], "low": b[1], "high": b[2]} for b in (below, above)) if c["n"]]
        for c in counts:
            if rank < c["n"]:
                n, low, high = c["n"], c["low"], c["high"]
                break
            rank -= c["n"]
    if low == high:
        return low
    return rows.filter(F.col("v").between(low, high)).orderBy("v").limit(rank + 1).agg(F.max("v")).first()[0]


def steps(df: DataFrame, value: str, *order: str) -> DataFrame:
    """One row for each value of a column: of several the last in the order given, which must be total; sorted by value, null first."""
    rest = [c for c in df.columns if c != value]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(value).agg(last).select(value, "_last.*").orderBy(value)


def positions(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """The place of each row in a total order, from 0."""
    one = F.lit(1).cast("long")
    return running_total(df.withColumn("_one", one), "_one", *order, name=name).drop("_one")


def running_total(df: DataFrame, value: str, *order: str | Column, name: str = "before") -> DataFrame:
    """The sum of a whole-number column over the rows that come before, in a total order.

    Rows are dealt by range, so no task sees them all: the sum is that of the ranges before plus that within one's own range.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpoint(ordered.withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # one row for each range
    ahead = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_ahead"))
    until = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(until), F.lit(0))
    out = dealt.withColumn("_own", own).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_own"))
    return out.drop("_range", "_own", "_ahead")


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """Numbers from 0 in the order of partitions and of their rows; none is moved."""
    placed = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each partition
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    found = placed.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return found.withColumn(name, F.col("_ahead") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_ahead")
