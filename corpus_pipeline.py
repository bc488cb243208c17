"""From raw documents to packed sequences: quality, exact copies, near copies, source mix, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm import common, exact_dedup, mixing, near_dedup, packing, quality
from meshwright.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier accepts; it learns from the labels of rows that aren't held out.

    Null and empty texts are scored as the empty text, very long ones whole; repeated rows are scored alike. Without labels of both kinds
    every row stays or, if all are 0, goes. Empty table: no rows.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.combine.any():  # nothing learned: nothing can be rejected
        return docs
    return quality.keep_good(docs, model)


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of equal texts (one, where rows repeat).

    A null text equals the empty one; very long texts are compared whole. A row without an id stays only where its group has no other.
    Empty table: no rows.
    """
    found = common.checkpoint(exact_dedup.find_duplicates(docs))
    # a row that repeats a kept row's id and text is dropped although its id stays
    sha = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    return _kept(docs, found, sha)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class of near copies (one, where rows repeat or have no id).

    Null and empty texts, and texts without words, resemble nothing and stay; very long texts are compared whole. Empty table: no rows.
    """
    found = common.checkpoint(near_dedup.near_duplicates(docs))
    return _kept(docs, found, F.sha2(common.text_or_empty().cast("binary"), 256))


def _kept(docs: DataFrame, found: DataFrame, sha: Column) -> DataFrame:
    """The rows of docs that found(doc_id, text_sha256, kept) keeps: as many of each id and text, which sha gives, as are kept there.

    Only rows whose id may be that of a dropped row are shuffled.
    """
    dropped = found.filter("not kept")
    far, near = common.split_by_ids(docs, dropped)
    _, told = common.split_by_ids(found, dropped)
    own, place = common.fresh(docs, "_own", "_place")
    told = told.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay")).filter("stay > 0").alias("t")
    rows = near.withColumn(own, sha).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"r.{own}") == F.col("t.text_sha256"))
    names = [F.col(f"r.`{c}`") for c in docs.columns]
    whole = rows.join(told.filter("stay = n"), same, "left_semi").select(*names)
    # rows that repeat in id and text, of which some stay
    nth = F.row_number().over(Window.partitionBy("r.doc_id", f"r.{own}").orderBy(F.lit(1)))
    some = rows.join(told.filter("stay < n"), same).withColumn(place, nth).filter(F.col(place) <= F.col("t.stay")).select(*names)
    return far.unionByName(whole).unionByName(some)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows that share an id and a size may swap their numbers of copies.

    Null and empty texts, and texts without words, have size 0 and come as often as their source's share says; a null source is a source
    of its own; null ids are rows as any other. Very long texts are sized whole. Empty table: no rows.

    The copies that all documents of a source get come from a table of sources, broadcast if it is counted to be small; only rows that may
    get one more are shuffled.
    """
    found = common.checkpoint(mixing.mix(docs))
    more = found.filter("copies > sure")
    far, near = common.split_by_ids(docs, more)
    key, place, copy = common.fresh(docs, "_key", "_place", "_copy")
    names = [F.col(f"r.`{c}`") for c in docs.columns]
    sure = common.checkpoint(found.groupBy("source").agg(F.first("sure").alias("sure")))
    far = common.beside(far, sure, "source").select(*names, F.col("s.sure").alias(copy))
    # copies of each id, size and source, in the order of their rows there
    _, told = common.split_by_ids(found, more)
    told = told.groupBy("doc_id", "size", "source").agg(F.count("*").alias("n"), F.count_if(F.expr("copies > sure")).alias("more"), F.first("sure").alias("sure"))
    told = told.alias("t")
    rows = near.withColumn(key, mixing.words(F.col("text"))).alias("r")
    same = F.col("r.doc_id").cast("long").eqNullSafe(F.col("t.doc_id")) & (F.col(f"r.{key}") == F.col("t.size"))
    near = rows.join(told, same & F.col("r.source").cast("string").eqNullSafe(F.col("t.source")))
    alike = near.filter("t.more in (0, t.n)").select(*names, (F.col("t.sure") + F.sign("t.more").cast("int")).alias(copy))
    nth = F.row_number().over(Window.partitionBy("t.doc_id", "t.size", "t.source").orderBy(F.lit(1)))
    apart = near.filter("t.more not in (0, t.n)").withColumn(place, nth)
    apart = apart.select(*names, (F.col("t.sure") + (F.col(place) <= F.col("t.more")).cast("int")).alias(copy))
    taken = far.unionByName(alike).unionByName(apart).filter(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(copy)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 token ids.

    A null text is empty: its end id alone is a piece. Very long texts fill whole sequences; null and repeated ids are packed as any other
    row. Empty table: no rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("exact_dedup", one_of_each_text), ("near_dedup", one_of_each_class), ("mixing", mixed), ("packing", packed)]

#: A trained classifier and sampling can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents; what each stage returns is written to the shared folder, read again and removed after the next stage."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
