"""What each filter of a chain removes, in every order of the chain, from counts of the documents that fail each set of filters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm import common

#: Filters by letter; the bit of the n-th in a mask is 2 ** n.
FILTERS = "ABCDE"
#: Keys for rows without an id, which meet no label.
SALT = 64


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: few words, repeated words, capitals, code characters."""
    words = F.filter(F.split(text, common.SPACE), lambda w: w != "")
    n = F.size(words)
    fails = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part and mask: part, mask, n, good (of them labelled quality 1), toxic (toxic 1).

    Texts are looked at once, where they are read; after that rows are an id, a sha256, a part and a mask. Copies are found by counting rows of each
    text and id first, so that neither a text nor a part that many rows share is gathered.
    """
    text = common.text_or_empty()
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.sha2(text.cast("binary"), 256).alias("sha"), failures(text).alias("mask"))
    each = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    told = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    # rows without an id are dealt over several keys
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(SALT))).otherwise(F.lit(0)).alias("salt")
    each = each.select("*", salt).join(told.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    # of each text's rows that are alike, the first id and its rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    no_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id")
    alike = each.groupBy("sha", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), no_id, first)
    # a text has at most four such rows for each part
    least = F.min("first.doc_id").over(Window.partitionBy("sha"))
    stay = F.col("no_id") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    cells = alike.withColumn("stay", stay).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("cell"),
    )
    cells = cells.select("part", "good", "toxic", "cell.*").filter("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def steps(cells: DataFrame) -> DataFrame:
    """Each cell at each step of each order, with the filters that it failed before: part, mask, n, good, toxic, filter_order, step, filter, bit, before."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    long = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("step", "filter"))
    long = long.withColumn("step", F.col("step") + 1).withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)"))
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    return long.withColumn("failed", failed).withColumn("before", F.coalesce(F.bit_or("failed").over(earlier), F.lit(0)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters A to E remove from docs(doc_id, text, lang), for each part (lang), order of the filters and step.

    A: under 200 words; B: under half of the words distinct; C: more than 3 % of characters are A to Z; D: a character of #$%&*|; E: the text
    of a smaller doc_id. Columns: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the
    filter's removed summed over all orders; divided by their number it is the Shapley value).

    Documents become counts of each part and mask (32 masks at most), which are unpivoted against the 600 steps of the 120 orders: a running bit-or over
    the steps tells what has failed before. The work after the counts doesn't grow with the documents.

    Nulls: a null text is empty and a null lang the part ''. A row without an id is no copy, nor is any row a copy of it; rows that repeat an id
    and a text aren't copies of each other, as neither id is smaller. Several labels of one id count if any is 1; labels without an id count for
    nothing. The empty text fails A alone (and E). Very long texts are looked at whole. Empty table: no rows. Other columns are ignored.
    """
    alive, fails = F.col("before") == 0, F.col("failed") != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0)).alias("x")
    metrics = {
        "kept": total("n", alive & ~fails), "removed": total("n", alive & fails), "redundant": total("n", ~alive & fails),
        "unique_fails": total("n", F.col("mask") == F.col("bit")),
        "good_lost": total("good", alive & fails), "toxic_lost": total("toxic", alive & fails),
    }
    each = steps(mask_cells(docs, labels)).groupBy("part", "filter_order", "step", "filter").agg(*(m.alias(c) for c, m in metrics.items()))
    return each.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
