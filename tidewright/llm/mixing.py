"""Mixing sources to target weights by systematic sampling.

Each source has a target in words; a document's expected copies are target / source size. Within a source,
documents are put in an order, their expected copies are summed up, one random offset is added, and a document
is emitted once for each whole number that its stretch of the running sum crosses. The order is by size, so
each stretch of like-sized documents is sampled at the source's rate and the words taken come out near the
target.

A source may hold most rows. Rows are range-partitioned by (source, size, random key), which splits any source
over many tasks; a task's ranks start after the row counts of the tasks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: The weights that sources get in turn.
WEIGHTS = (3, 1, 2)


def random_key(*columns: Column, seed: int = 7) -> Column:
    """Hex digits that any engine can reproduce: MD5 of the values and the seed, joined by '/'."""
    return F.md5(F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns], F.lit(str(seed))))


def source_targets(sized: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from rows of (source, size).

    Sources in code-point order, null last, get the weights in turn and share ``share`` of all sizes. No
    target goes over ``limit`` times its source's size; the excess is shared again by weight. The level at
    which this settles is found in one pass: sources sorted by how soon they fill up, with running sums. That pass is
    one task over a row a source, meant for up to some millions of sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = totals.withColumn("w", cycle[(F.row_number().over(order) - 1) % len(weights)])
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    run = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_size"),
        F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_w"),
    )
    # With every source before this one full, this level a unit of weight is left for the others.
    level = (F.lit(share) * F.col("all_size") - F.lit(limit) * F.col("full_size")) / F.col("open_w")
    run = run.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.lit(limit) * F.col("source_size"))
    settled = F.max(F.when(F.col("fits"), F.struct(F.col("open_w"), F.col("level")))).over(everything)["level"]
    run = run.withColumn("settled", settled)
    target = F.least(F.col("settled") * F.col("w"), F.lit(limit) * F.col("source_size"))
    return run.select("source", "source_size", F.coalesce(target, F.lit(limit) * F.col("source_size")).alias("target"))


def copies(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, <carry>)`` for each row of ``docs``.

    size counts words of the whole text (null: 0). Null sources are one source. Rows that repeat an id in a
    source and size are interchangeable. A source of size zero has target zero and its rows get no copy.
    Extra columns are ignored; an empty table gives no rows. Reruns give the same rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    # A key without nulls that sorts as the sources do, null last.
    skey = F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), "source")).alias("skey")
    sized = cut(docs.select("doc_id", "source", skey, size.alias("size"), random_key(F.col("doc_id"), seed=seed).alias("h"), *carry))
    targets = source_targets(sized, share, limit, weights).select(skey, "source_size", "target")
    parts = max(1, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(sized.repartitionByRange(parts, "skey", "size", "h", "doc_id").withColumn("part", F.spark_partition_id()))
    cell = dealt.groupBy("part", "skey").agg(F.count("*").alias("n"))  # tasks + sources rows
    start = F.sum("n").over(Window.partitionBy("skey").orderBy("part")) - F.col("n")
    cells = cell.select("part", "skey", start.alias("start")).join(targets, "skey")
    within = Window.partitionBy("part", "skey").orderBy("size", "h", "doc_id")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(cells, ["part", "skey"])
    offset = F.conv(F.substring(random_key(F.col("source"), F.lit("offset"), seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("start") + F.col("rank")
    crossed = F.floor(offset + place * rate) - F.floor(offset + (place - 1) * rate)
    return ranked.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), *carry)
