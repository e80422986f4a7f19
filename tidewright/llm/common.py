"""Shared helpers: shared-folder checkpoints, bounded Arrow batches, word splitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import cut, remove, shared_dir  # noqa: F401  the operators take them from here

#: ASCII white space as the data contracts define it ([\x20\x09-\x0D]).
WHITE = b" \t\n\x0b\x0c\r"
#: The same set as a Java regular expression for words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch, for tables that hold some very long texts.

    A session's setting, the same for every operator, so lazy frames may run in any order.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(name: str = "text"):
    """A text column as bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def rows_of(batch: pa.RecordBatch, column: int, step: int = 256) -> Iterator[list]:
    """A column's values in lists of at most ``step``, so that one batch never exists twice as objects."""
    values = batch.column(column)
    for start in range(0, len(values), step):
        yield values.slice(start, step).to_pylist()


def bounded_sample(rows: DataFrame, limit: int, *ties: str) -> DataFrame:
    """At most ``limit`` distinct rows, those of the smallest hash of doc_id, for fitting a model.

    The hash is cut off a little above where the limit should fall, so that no task sorts or sends many more
    rows than its share of the sample.
    """
    rows = rows.distinct()  # rows that repeat an id would crowd out others
    h, n = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), rows.count()
    if n > limit:
        rows = rows.where(h < math.ceil((1 << 31) * min(1.0, (limit + 6 * math.sqrt(limit) + 10) / n)))
    return rows.orderBy(h, "doc_id", *ties).limit(limit)
