"""Reliable checkpoints and stage outputs in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none, a local master gets a folder of its own, deleted at exit; on a cluster that is an error, as
    executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="tidewright-ckpt-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(named or own)
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: lost executors read the shared folder again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever file system its path names, so that it lies beside the tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
