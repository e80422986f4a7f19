"""SimHash near-duplicates by multi-index hashing.

Every document gets a 64-bit SimHash of its word shingles. Two fingerprints link when they differ in at
most two bits; linked fingerprints form components, and a component is named by its smallest document id.

Candidates come from multi-index hashing on two levels. The 64 bits are cut into segments; by the pigeonhole
principle a pair within the radius has a segment in which it lies within a small Hamming ball (radius 1 or 0). What
is left of the radius is spent on the other bits in the same way: they are cut into segments, one of which lies in a
small ball again. So a table key is a segment and a segment of the rest, for radius 2 three quarters of the
fingerprint. Each fingerprint probes the balls' points (``cover`` lists them: 100 for radius 2, half of which are
met from one side only), fetches the table's matches and is verified over all 64 bits.

The keys are the same at every size of the data and of a bucket. A bucket has at most 2**16 distinct fingerprints, as
only 16 bits are free in it, so no value can fill a task, and random fingerprints hardly ever meet. The index holds
distinct fingerprints, so copies never multiply.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bound_batches, cut, rows_of, utf8
from .graph import components

SEED = 42
CHUNK = 4096


def simhash(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text (UTF-8).

    A-Z is lower-cased; words are runs without ASCII white space; shingles keep their repeats and are joined
    by single spaces. Fewer words than a shingle: the whole sequence is the one shingle. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, total = [b" ".join(words)], 1
    else:
        grams, total = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=total)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, total, CHUNK):
        part = hashes[start : start + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp long, <carry>)`` for each row; null text counts as empty, ids may be null or repeated."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t, shingle) for part in rows_of(batch, 1) for t in part], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), *carry)
    return narrow.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"`{c}` {t}" for c, t in narrow.dtypes[2:])]))


def hex_of(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def cover(radius: int, levels: int = 2, free: tuple[int, ...] = tuple(range(64))) -> list[tuple[int, int]]:
    """Keys (bits kept, bits flipped), as masks, of which every pair within ``radius`` differing bits shares one.

    Segments have radius 1 or 0, and their radii with one more each add up to one more than ``radius``: a pair cannot
    go beyond all of them. Each point of a segment's ball leaves the rest of the radius to the other bits.
    """
    if not levels or not free:
        return [(0, 0)]
    count = radius + 1 if radius < 2 else radius // 2 + 1
    wide = radius + 1 - count  # segments of radius 1; the last ones have radius 0
    out = []
    for k in range(count):
        segment = free[k * len(free) // count : (k + 1) * len(free) // count]
        rest = tuple(b for b in free if b not in segment)
        for flip in [0, *(1 << b for b in segment)] if k < wide else [0]:
            out += [(sum(1 << b for b in segment) | keep, flip | more) for keep, more in cover(radius - (flip > 0), levels - 1, rest)]
    return list(dict.fromkeys(out))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """All links ``(a, b)``, a < b, between distinct fingerprints (column ``fp``) within ``radius`` differing bits."""
    keys = cover(radius)
    tables = {keep: t for t, keep in enumerate(dict.fromkeys(keep for keep, _ in keys))}
    constant = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)  # noqa: E731  of the radius, not of the data
    kept = constant([{"t": t, "keep": _signed(keep)} for keep, t in tables.items()], "array<struct<t:int,keep:bigint>>")
    table = distinct.select(F.col("fp").alias("b"), F.explode(kept).alias("k")).select("b", "k.t", F.col("b").bitwiseAND(F.col("k.keep")).alias("key"))
    points = constant([{"t": tables[keep], "keep": _signed(keep), "flip": _signed(flip), "first": _signed(flip & -flip)} for keep, flip in keys], "array<struct<t:int,keep:bigint,flip:bigint,first:bigint>>")
    # Of two fingerprints that differ in flipped bits, the one with zero in the first of them finds the other.
    probes = distinct.select(F.col("fp").alias("a"), F.explode(points).alias("p")).where(F.col("a").bitwiseAND(F.col("p.first")) == 0)
    probes = probes.select("a", F.col("p.t").alias("t"), F.col("a").bitwiseXOR(F.col("p.flip")).bitwiseAND(F.col("p.keep")).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    p, q = probes.alias("p"), table.alias("q")
    pairs = p.join(q, (F.col("p.t") == F.col("q.t")) & (F.col("p.key") == F.col("q.key")) & (F.col("a") != F.col("b")) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, component_id, root, <carry>)`` for each row of ``docs``; root is the component's smallest fingerprint.

    component_id is the smallest id reachable over links, the row's own included; null ids are reachable but
    never the smallest (null only if the whole component has none). Repeated rows share a fingerprint. An empty
    table gives an empty result. Extra columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle, carry))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), radius))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first_id")
    names = linked.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    linked = linked.join(names, "root").select("fp", "root", "linked_id")
    # Behind a checkpoint both sides of the last join are plain exchanges, which a frequent fingerprint can't fill: Spark splits them.
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("linked_id", "first_id").alias("component_id"))
    return prints.join(cut(named), "fp", "left").select("doc_id", "fp", "component_id", "root", *carry)
