"""Cutting lineage in iterative plans through the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or where that is unset the one given to setCheckpointDir.

    Without either, a session of one process (local[n], as in tests) gets a folder of its own. On a cluster that is an error, as no folder
    of one machine is shared.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder and re.fullmatch(r"local(\[.*\])?", context.master):
        folder = tempfile.mkdtemp(prefix="spark-")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder, so that a lost executor loses nothing.

    Spark drops the files with the plan only where spark.cleaner.referenceTracking.cleanCheckpoints is true; else they stay until the folder is cleared.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """df as the right side of a join that deals both sides out by their keys.

    Spark takes the size of rows that are exploded, or made from a narrow table, for that of the file they come from, and would send many
    times its limit through the driver to all executors.
    """
    return df.hint("merge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the place that executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch_path whose contents nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
