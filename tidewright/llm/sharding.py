"""Uniform shuffle into shards of exact sizes, with a hypergeometric communication matrix.

Rows lie in P partitions (a hash of the id). A uniform random permutation cut into shards of given sizes sends
a random number of rows from each partition to each shard; these counts follow a multivariate hypergeometric
law whose row sums are the partitions' sizes and whose column sums are the shards' sizes. The matrix is drawn
from that law, to the precision of doubles; each partition is permuted locally and its rows dealt out by its row of the matrix; rows are
exchanged; each shard is permuted again, in blocks, which gives every row its slot.

Everything on rows is DataFrame functions. The driver sees P counts and draws P x S numbers; P is a constant
(``PARTITIONS``), so what is collected and broadcast does not grow with the data. Randomness is a hash of the
row and a seed, so a lost task is recomputed to the same rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Partitions of the matrix, and blocks of each shard's second permutation.
PARTITIONS, BLOCKS = 2048, 256


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Draws for counts of any size. numpy's own sampler stops at 10**9; beyond, the law is inverted within 14 deviations
    of its mode, outside of which less than 1e-40 of it lies, with weights in double precision."""
    large = (good >= 10**9) | (bad >= 10**9)
    out = rng.hypergeometric(np.where(large, 0, good), np.where(large, 0, bad), np.where(large, 0, draws))
    for k in np.flatnonzero(large):
        g, b, n = int(good[k]), int(bad[k]), int(draws[k])
        low, high = max(0, n - b), min(g, n)
        mode = min(high, max(low, (n + 1) * (g + 1) // (g + b + 2)))
        width = int(14 * math.sqrt(n * (g / (g + b)) * (b / (g + b)) + 1)) + 16
        x = np.arange(max(low, mode - width), min(high, mode + width) + 1, dtype=np.float64)
        ratio = np.log((g - x[:-1]) * (n - x[:-1])) - np.log((x[:-1] + 1) * (b - n + x[:-1] + 1))
        weight = np.exp((logs := np.concatenate([[0.0], np.cumsum(ratio)])) - logs.max()).cumsum()
        out[k] = int(x[np.searchsorted(weight, rng.random() * weight[-1], side="right").clip(0, len(x) - 1)])
    return out


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Random matrix with these row and column sums, as a uniform permutation would fill it.

    Halves the set of rows again and again: of a block's column sums, those of its upper half are multivariate
    hypergeometric. All blocks of a level are drawn at once.
    """
    if sum(rows) != sum(columns):
        raise ValueError("row sums and column sums differ")
    rng, depth = np.random.default_rng(seed), max(0, (len(rows) - 1).bit_length())
    sizes = np.zeros(1 << depth, dtype=np.int64)
    sizes[: len(rows)] = rows
    blocks = np.array([columns], dtype=np.int64)
    for level in range(depth):
        upper = sizes.reshape(2 << level, -1).sum(axis=1)[::2]
        taken, need, left = np.zeros_like(blocks), upper.copy(), blocks.sum(axis=1)
        for s in range(blocks.shape[1]):
            left = left - blocks[:, s]
            taken[:, s] = _hypergeometric(rng, blocks[:, s], left, need)
            need = need - taken[:, s]
        blocks = np.stack([taken, blocks - taken], axis=1).reshape(2 << level, -1)
    return blocks[: len(rows)]


def _draw(columns: list[Column], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shard_rows(df: DataFrame, shards: int = 16, keys: tuple[str | Column, ...] = ("doc_id",), seed: int = 20240229, partitions: int = PARTITIONS, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard).

    Shard sizes differ by one row at most. ``keys`` (names, or expressions over
    ``df``) feed the random draws; rows that agree on all of them are
    interchangeable, so which of them gets which place is not defined. Null keys count as a value. Columns of
    the input named shard or slot are replaced. An empty table stays empty.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    row = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
    drawn = df.select(*[F.col(f"`{c}`") for c in names], F.pmod(_draw(row, seed), F.lit(partitions)).cast("int").alias("__part"))
    counts = {r[0]: r[1] for r in drawn.groupBy("__part").agg(F.count("*")).collect()}  # PARTITIONS rows at most
    n = sum(counts.values())
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(partitions)], sizes, seed)
    bounds = json.dumps(matrix.cumsum(axis=1)[:, :-1].tolist())
    plan = df.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(bounds), "array<array<bigint>>")).alias("__part", "__bounds"))
    local = Window.partitionBy("__part").orderBy(_draw(row, seed + 1), *row)
    ranked = drawn.withColumn("__rank", F.row_number().over(local) - 1).join(F.broadcast(plan), "__part")
    shard = sum(((F.col("__rank") >= F.col("__bounds")[s]).cast("int") for s in range(shards - 1)), F.lit(0))
    # Not checkpointed, which would write every row twice: equal keys have equal blocks, so both reads below agree.
    dealt = ranked.select(*[F.col(f"`{c}`") for c in names], shard.alias("shard"), F.pmod(_draw(row, seed + 2), F.lit(blocks)).cast("int").alias("__block"))
    # The blocks of a shard follow each other: their sizes, summed up, are where each begins.
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__block")) - F.col("__n")
    starts = dealt.groupBy("shard", "__block").agg(F.count("*").alias("__n")).select("shard", "__block", before.alias("__start"))
    within = Window.partitionBy("shard", "__block").orderBy(_draw(row, seed + 3), *row)
    placed = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "__block"])
    return placed.select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("__rank") + F.col("__start")).cast("long").alias("slot"))
