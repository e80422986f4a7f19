"""Quality from document statistics: a classifier, and rules with a monotonic model behind them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import bounded_sample, cut
from .doc_stats import BASE, FEATURES, document_statistics

#: Labelled rows that a model is fitted on, at most (those of the smallest id hash).
MAX_LABELLED = 20_000
#: Features that can only lower the rules' score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "exclaim_share", "symbol_words")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 3; fold 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def fit_on(stats: DataFrame, labels: DataFrame, label: str = "quality", monotone: dict[int, int] | None = None, limit: int = MAX_LABELLED) -> gbdt.Forest:
    """Fit on labelled rows outside fold 1, ``limit`` of them at most; null labels and ids don't count.

    Of documents that share a labelled id the one with the least features counts, so ``limit`` also bounds what
    comes to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1)).select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
    rows = stats.select("doc_id", "features").join(cut(bounded_sample(known, limit, "y")), "doc_id")
    got = rows.groupBy("doc_id", "y").agg(F.min("features").alias("features")).orderBy("doc_id", "y").select("features", "y").collect()
    x = np.array([r[0] for r in got], dtype=float).reshape(-1, len(FEATURES))
    return gbdt.fit(x, np.array([r[1] for r in got], dtype=float), monotone)


def _scored(stats: DataFrame, forest: gbdt.Forest, columns: list[str]) -> DataFrame:
    """The columns, and ``score``, by traversing the node arrays a batch at a time."""
    at = [stats.columns.index(c) for c in columns]
    where = stats.columns.index("features")
    schema = ", ".join(f"{c} {t}" for c, t in stats.dtypes if c in columns) + ", score double"

    def run(batches):
        for batch in batches:
            x = batch.column(where).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), pa.array(forest.score(x))], names=[*columns, "score"])

    return stats.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    score is the model's probability of label 1 from text statistics alone. Null and empty texts are scored
    as empty. Null ids are in no fold and not held out. Without labels every score is the constant 0.5.
    """
    stats = cut(document_statistics(docs))
    forest = fit_on(stats, labels, limit=limit)
    scored = _scored(stats, forest, ["doc_id"])
    held = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, <base counts>, base_failed, score, kept)`` for each row of ``docs``.

    Base rule: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. A document that
    passes it is kept if the monotonic model's score reaches ``threshold``. Null texts count as empty (they
    fail the base rule). Without labels the model's score is 0.5 and the base rule alone decides.
    """
    stats = cut(document_statistics(docs))
    forest = fit_on(stats, labels, monotone={FEATURES.index(f): -1 for f in FALLING}, limit=limit)
    scored = _scored(stats, forest, ["doc_id", *BASE])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
