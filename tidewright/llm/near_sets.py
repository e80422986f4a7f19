"""Near copies by SimHash, each verified by the exact Jaccard similarity of word shingles.

Two texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; linked texts
form components. At that similarity 15 % of a SimHash's bits differ, so 64 bits and a small radius cannot find them.

A text's SimHash has ``SEGMENTS`` * ``WORDS`` words of 64 bits: each bit says whether it is set in over half of the
shingles' hashes. Bits near a tie are the ones that flip, so the index does not take fixed bits: of each word it keys
the most decided bit, position and value, and a key is the ``WORDS`` of these of one segment. In the two least
decided words of a segment the runner-up is probed as well, four keys a segment. Texts that share a key meet; those
within ``RADIUS`` of the first ``PRINT`` * 64 bits are candidates, and each candidate is verified on the whole sets,
so a link is never wrong (but for collisions of 64-bit shingle hashes). A pair is found by chance, if almost surely:
the README has the figures.

Copies never multiply: nodes are distinct shingle sets. Buckets of up to ``bucket_limit`` sets form pairs, which
are verified once each. Larger buckets are dealt into blocks, any two blocks of a bucket meet in one group, and a
group returns a spanning forest of its links, so rows grow with the number of blocks and no pair becomes a row.
The comparisons in such a bucket grow with the square of its sets only as far as they do not link.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from .common import bound_batches, cut, rows_of, utf8
from .graph import components

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
SEGMENTS, WORDS, PRINT, RADIUS = 40, 4, 4, 80
_draws = np.random.default_rng(SEED).integers(0, 1 << 63, size=(3, SEGMENTS * WORDS), dtype=np.uint64)
_MASKS, _ODD, _MIX = _draws[0], _draws[1] * np.uint64(2) + np.uint64(1), _draws[2] * np.uint64(2) + np.uint64(1)
#: Shingles counted at once: three, then five, then sixteen numbers are added in lanes of 2, 4 and 8 bits.
CHUNK = 3 * 5 * 16
_LANES = [np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles. Words and short texts as in ``simhash.simhash``; no word: empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=max(1, len(words) - size + 1)))


def counters(found: np.ndarray) -> np.ndarray:
    """For each bit of the SimHash, by words of 64: hashes that have it set less hashes that have not."""
    ones = np.zeros((len(_MASKS), 8, 8), dtype=np.int64)
    two, four, eight = _LANES
    for start in range(0, len(found), CHUNK):
        part = found[start : start + CHUNK]
        x = (part[:, None] ^ _MASKS) * _ODD
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        if len(x) % 15:
            x = np.concatenate([x, np.zeros((15 - len(x) % 15, x.shape[1]), dtype=np.uint64)])
        for i in range(2):
            y = (x >> np.uint64(i)) & two
            y = y[0::3] + y[1::3] + y[2::3]
            for j in (0, 2):
                z = (y >> np.uint64(j)) & four
                z = z[0::5] + z[1::5] + z[2::5] + z[3::5] + z[4::5]
                for k in (0, 4):
                    ones[:, :, i + j + k] += ((z >> np.uint64(k)) & eight).sum(axis=0).view(np.uint8).reshape(-1, 8)
    return 2 * ones.reshape(-1, 64) - len(found)


def sketch(found: np.ndarray) -> tuple[bytes, list[int]]:
    """What the index keeps of a set: 7 bytes a segment, and the first words of its SimHash. No keys for an empty set.

    The bytes are the most decided bit of each word (twice its position, plus its value), the runners-up in the two
    least decided words, and which words these are.
    """
    if not len(found):
        return b"", [0] * PRINT
    balance = counters(found)
    simhash = np.packbits(balance[:PRINT] > 0, axis=1, bitorder="little").view("<i8").ravel()
    sure, row = np.abs(balance), np.arange(len(balance))
    first = sure.argmax(axis=1)
    most = sure[row, first]
    sure[row, first] = -1
    second = sure.argmax(axis=1)
    bits = [(2 * at + (balance[row, at] > 0)).reshape(SEGMENTS, WORDS) for at in (first, second)]
    open_ = np.argsort((most - sure[row, second]).reshape(SEGMENTS, WORDS), axis=1, kind="stable")[:, :2]
    return np.hstack([bits[0], np.take_along_axis(bits[1], open_, axis=1), open_[:, :1] * WORDS + open_[:, 1:]]).astype(np.uint8).tobytes(), simhash.tolist()


def keys_of(kept: bytes) -> np.ndarray:
    """The keys of a sketch, four for each segment, all different."""
    rows = np.frombuffer(kept, dtype=np.uint8).reshape(-1, WORDS + 3).astype(np.int64)
    shift = 7 * np.arange(WORDS)
    base = (rows[:, :WORDS] << shift).sum(axis=1) + (np.arange(len(rows)) << 7 * WORDS)
    turn = []
    for n, at in ((WORDS, rows[:, -1] // WORDS), (WORDS + 1, rows[:, -1] % WORDS)):
        turn.append((rows[:, n] - np.take_along_axis(rows, at[:, None], axis=1)[:, 0]) << shift[at])
    return np.concatenate([base, base + turn[0], base + turn[1], base + turn[0] + turn[1]])


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set's SimHash; none for an empty set."""
    return keys_of(sketch(found)[0])


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Jaccard similarity of two sorted sets is at least this."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning forest of the links among these sets: each set is held against those not yet reached."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(at, kind="stable")
    holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(values)))])
    open_, edges = np.ones(len(sets), dtype=bool), []
    for seed in range(len(sets)):
        if not open_[seed]:
            continue
        open_[seed], queue = False, [seed]
        while queue and open_.any():
            k = queue.pop()
            mine = at[ends[k] : ends[k + 1]]
            both = np.bincount(np.concatenate([holders[first[v] : first[v + 1]] for v in mine]), minlength=len(sets))
            near = np.flatnonzero(open_ & (both >= similarity * (sizes + sizes[k] - both) - 1e-9))
            open_[near] = False
            edges += [(k, int(x)) for x in near]
            queue += near.tolist()
    return edges


def _as_set(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u8")


_PRINTS = [f"p{k}" for k in range(PRINT)]


def signatures(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(sid, sketch, p0.., <carry>)`` for each row: a digest of its shingle set, and what ``sketch`` returns."""

    def run(batches):
        for batch in batches:
            sids, kept, prints = [], [], []
            for part in rows_of(batch, 0):
                for text in part:
                    found = shingles(text)
                    sids.append(xxh128_digest(found.tobytes(), seed=SEED))
                    one, simhash = sketch(found)
                    kept.append(one)
                    prints.append(simhash)
            words = [pa.array([p[k] for p in prints], pa.int64()) for k in range(PRINT)]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(kept, pa.binary()), *words, *batch.columns[1:]], names=["sid", "sketch", *_PRINTS, *carry])

    narrow = docs.select(utf8(text_col).alias("text"), *carry)
    return narrow.mapInArrow(run, ", ".join(["sid binary, sketch binary", *(f"{p} bigint" for p in _PRINTS), *(f"`{c}` {t}" for c, t in narrow.dtypes[1:])]))


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(nid, bucket)``: each key of each node."""

    def run(batches):
        for batch in batches:
            nids = batch.column(0).to_numpy()
            for start in range(0, len(nids), 100):
                keys = [keys_of(kept) for kept in batch.column(1).slice(start, 100).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nids[start : start + 100], [len(k) for k in keys])), pa.array(np.concatenate(keys))], names=["nid", "bucket"])

    return nodes.select("nid", "sketch").mapInArrow(run, "nid bigint, bucket bigint")


def _sets(texts: DataFrame) -> DataFrame:
    """``(sid, shingles)``: the whole sets, as bytes."""

    def run(batches):
        for batch in batches:
            found = [shingles(text).tobytes() for part in rows_of(batch, 1) for text in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["sid", "shingles"])

    return texts.mapInArrow(run, "sid binary, shingles binary")


def links(nodes: DataFrame, texts: DataFrame, key: str, bucket_limit: int = 8, block: int = 200) -> DataFrame:
    """Verified links ``(a, b)`` between distinct sets; ``nodes`` has what ``signatures`` returns and the ``key`` of one of its ``texts``.

    Their components are those of all candidate pairs at ``SIMILARITY`` or more.
    """
    nodes = nodes.withColumn("nid", F.xxhash64("sid"))
    # One exchange of narrow rows: a window counts a bucket where its rows lie already.
    met = cut(_buckets(nodes).withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"))
    small = met.where(F.col("n") <= bucket_limit).groupBy("bucket").agg(F.sort_array(F.collect_list("nid")).alias("nids"))
    heads = small.select("nids", F.posexplode("nids").alias("k", "x"))
    pairs = heads.select("x", F.explode(F.expr("slice(nids, k + 2, size(nids))")).alias("y")).distinct()
    side = lambda nid, sid, mark: nodes.select(F.col("nid").alias(nid), F.col("sid").alias(sid), *(F.col(p).alias(mark + p) for p in _PRINTS))
    differ = sum((F.bit_count(F.col("x" + p).bitwiseXOR(F.col("y" + p))) for p in _PRINTS), F.lit(0))
    near = cut(pairs.join(side("x", "a", "x"), "x").join(side("y", "b", "y"), "y").where(differ <= RADIUS).select("a", "b"))
    crowd = cut(met.where(F.col("n") > bucket_limit).join(nodes.select("nid", "sid"), "nid").select("sid", "bucket", "n"))

    wanted = near.select(F.col("a").alias("sid")).union(near.select("b")).union(crowd.select("sid")).distinct()
    wanted = nodes.select("sid", key).join(wanted, "sid", "left_semi")
    sets = cut(_sets(texts.join(wanted, key).select("sid", utf8())).groupBy("sid").agg(F.first("shingles").alias("shingles")))
    sided = near.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")

    def verify(batches):
        for batch in batches:
            good = [alike(_as_set(x), _as_set(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    found = sided.select("a", "b", "sa", "sb").mapInArrow(verify, "a binary, b binary")

    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = crowd.withColumn("parts", parts).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("i")))
    spread = dealt.withColumn("j", F.explode(other)).select("bucket", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "sid")

    def group(rows: pa.Table) -> pa.Table:
        sids = rows.column("sid").to_pylist()
        edges = forest([_as_set(x) for x in rows.column("shingles").to_pylist()])
        return pa.table({"a": pa.array([sids[a] for a, _ in edges], pa.binary()), "b": pa.array([sids[b] for _, b in edges], pa.binary())})

    crowded = spread.join(sets, "sid").groupBy("bucket", "low", "high").applyInArrow(group, "a binary, b binary")
    return found.unionByName(crowded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_copies(docs: DataFrame, key: str, bucket_limit: int = 8, block: int = 200) -> DataFrame:
    """``docs`` without its text, with ``root``: the digest that names the row's component.

    ``key`` tells texts apart. Rows without words are one component; null text counts as empty. An empty table
    gives an empty result.
    """
    bound_batches(docs.sparkSession)
    carry = tuple(c for c in docs.columns if c != "text")
    prints = cut(signatures(docs, carry=carry))
    nodes = cut(prints.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("sketch", *_PRINTS)), F.min(key).alias(key)))
    roots = components(links(nodes, docs.select(key, "text"), key, bucket_limit, block))
    named = nodes.select("sid").join(roots, nodes["sid"] == roots["node"], "left").select("sid", F.coalesce("root", "sid").alias("root"))
    return prints.join(cut(named), "sid").select(*carry, "root")
