"""Documents with an order and one root, written by many tasks as numbered parts."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

#: The list of a document's parts, in order; Spark's readers pass over names that begin so.
LIST = "_parts"


def write_parts(lines: DataFrame, order: list[str], path: str) -> list[str]:
    """lines(value, *order) as text files below path which, joined in the order of LIST, are the lines in order. Returns their names.

    Rows are dealt by range, so each task writes a stretch of its own and the head and the tail lie in the first and last part. What a failed or repeated
    task leaves isn't there once the job commits; the list is written after that, so a document with a list is whole.
    """
    spark = lines.sparkSession
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    names = [f.rstrip("/").rsplit("/", 1)[-1] for f in spark.read.text(path).inputFiles()]
    names.sort(key=lambda n: int(re.match(r"part-(\d+)", n).group(1)))
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.text(f"{path}/{LIST}")
    return names


def parts(spark: SparkSession, path: str) -> list[str]:
    """The names of a document's parts, in order."""
    return json.loads(spark.read.text(f"{path}/{LIST}").first()["value"])
