"""Exact dedup with a log-structured merge index over text digests.

Every task keeps an index of its own rows. The memtable maps digests to texts, identifiers and counts; hits in
it are verified on bytes at once. A full memtable is flushed as a run sorted by digest with a Bloom filter.
Runs are compacted level by level: of a digest's entries the preferred identifier survives (the smallest, or
the largest on request) and counts add up. A run that has grown to ``RUN_ROWS`` entries leaves the task's memory as
rows of the index table, so memory does not grow with a task's rows. What a task sends on is one entry for each
digest in such a run, so a text with very many copies shrinks to an entry a run before anything is shuffled; the
same compaction then runs between tasks as an aggregate.

A hit between runs or tasks is verified on bytes too, by a second scan: a filter over (digest, identifier) of the
entries in question admits their rows, one text for an entry and not the copies' texts, and the least and the greatest
text of a digest must agree. Digests whose entries differ (a collision) are regrouped by their whole texts' SHA-256.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bound_batches, cut, rows_of, utf8

#: A memtable is flushed beyond these rows or bytes of text.
MEMTABLE_ROWS, MEMTABLE_BYTES = 10_000, 32 << 20
#: A task's runs leave memory as rows beyond these entries.
RUN_ROWS = 100_000
#: Bits of the verifying scan's filter for each entry in question, and in all, whatever the data's size. Beyond the
#: latter it admits more rows than are wanted, which costs time and changes no result.
FILTER_BITS_EACH, FILTER_BITS_MOST = 16, 1 << 26

DOC, ENTRY, CHECK = 0, 1, 2


def slots(digest: bytes, size: int, probes: int = 4) -> list[int]:
    """Filter positions of a digest; digests are uniform already, so two of their words make all probes."""
    low = int.from_bytes(digest[:8], "little")
    step = int.from_bytes(digest[8:16], "little") | 1
    return [((low + i * step) & 0xFFFFFFFFFFFFFFFF) % size for i in range(probes)]


class BloomFilter:
    def __init__(self, entries: int, bits_per_entry: int = 10):
        self.size = max(64, entries * bits_per_entry)
        self.bits = bytearray(self.size // 8 + 1)

    def add(self, digest: bytes) -> None:
        for s in slots(digest, self.size):
            self.bits[s >> 3] |= 1 << (s & 7)

    def __contains__(self, digest: bytes) -> bool:
        return all(self.bits[s >> 3] >> (s & 7) & 1 for s in slots(digest, self.size))


class MergeIndex:
    """Memtable, runs sorted by digest with filters, and compaction of ``fanout`` runs of a level into one.

    An entry is (digest, identifier, count). ``hits`` lists (digest, identifier) of entries that met an older
    entry of their digest without their bytes having been compared.
    """

    def __init__(self, prefer: Callable = min, rows: int = MEMTABLE_ROWS, bytes_: int = MEMTABLE_BYTES, fanout: int = 8):
        self.rows, self.bytes, self.fanout = rows, bytes_, fanout
        self.prefer = lambda a, b: b if a is None else a if b is None else prefer(a, b)
        self.mem: dict[bytes, list[list]] = {}
        self.levels: list[list[tuple[list, BloomFilter]]] = []
        self.hits: list[tuple[bytes, object]] = []
        self.held = 0
        self.flushed = 0

    def put(self, digest: bytes, text: bytes, ident) -> None:
        versions = self.mem.setdefault(digest, [])
        for entry in versions:
            if entry[0] == text:
                entry[1], entry[2] = self.prefer(entry[1], ident), entry[2] + 1
                return
        versions.append([text, ident, 1])
        self.held += len(text)
        if len(self.mem) >= self.rows or self.held >= self.bytes:
            self.flush()

    def flush(self) -> None:
        run = []
        for digest in sorted(self.mem):
            first, *others = self.mem[digest]
            ident, count = first[1], first[2]
            for other in others:  # one digest, other bytes
                self.hits += [(digest, first[1]), (digest, other[1])]
                ident, count = self.prefer(ident, other[1]), count + other[2]
            if not others and self.get(digest):
                self.hits.append((digest, ident))
            run.append((digest, ident, count))
        self.mem, self.held, level = {}, 0, 0
        self.flushed += len(run)
        while run:
            if len(self.levels) == level:
                self.levels.append([])
            bloom = BloomFilter(len(run))
            for entry in run:
                bloom.add(entry[0])
            self.levels[level].append((run, bloom))
            if len(self.levels[level]) < self.fanout:
                break
            run, self.levels[level], level = self.compacted(r for r, _ in self.levels[level]), [], level + 1

    def compacted(self, runs) -> list[tuple]:
        out: list[tuple] = []
        for digest, ident, count in heapq.merge(*runs, key=lambda e: e[0]):
            if out and out[-1][0] == digest:
                self.hits.append((digest, out[-1][1]))
                out[-1] = (digest, self.prefer(out[-1][1], ident), out[-1][2] + count)
            else:
                out.append((digest, ident, count))
        return out

    def get(self, digest: bytes):
        """(identifier, count) over all runs; a run whose filter lacks the digest is not searched."""
        found = None
        for run, bloom in (x for level in self.levels for x in level):
            if digest in bloom:
                k = bisect_left(run, digest, key=lambda e: e[0])
                if k < len(run) and run[k][0] == digest:
                    found = run[k][1:] if found is None else (self.prefer(found[0], run[k][1]), found[1] + run[k][2])
        return found

    def entries(self) -> list[tuple]:
        """Everything flushed and compacted into one run."""
        self.flush()
        return self.compacted(r for level in self.levels for r, _ in level)

    def leave(self) -> tuple[list[tuple], set[tuple]]:
        """One run of everything, and its unverified hits; the index is empty afterwards."""
        run, hits = self.entries(), set(self.hits)
        self.levels, self.hits, self.flushed = [], [], 0
        return run, hits


def _ingest(largest: bool, digest_bytes: int):
    names = ["kind", "doc_id", "digest", "n"]
    types = [pa.int8(), pa.int64(), pa.binary(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def rest(index: MergeIndex):
        run, hits = index.leave()
        rows = [(ENTRY, i, d, n) for d, i, n in run] + [(CHECK, i, d, 0) for d, i in hits]
        for start in range(0, len(rows), 10_000):
            yield batch_of(rows[start : start + 10_000])

    def run(batches):
        index = MergeIndex(prefer=max if largest else min)
        for batch in batches:
            ids, out = iter(batch.column(0).to_pylist()), []
            for part in rows_of(batch, 1):
                for text in part:
                    sha, ident = hashlib.sha256(text).digest(), next(ids)
                    index.put(sha[:digest_bytes], text, ident)
                    out.append((DOC, ident, sha, 1))
            if out:
                yield batch_of(out)
            if index.flushed >= RUN_ROWS:
                yield from rest(index)
        yield from rest(index)

    return run


def _entry_key(digest: Column, ident: Column) -> Column:
    return F.concat(digest, F.coalesce(ident.cast("string"), F.lit("~")).cast("binary"))


def _scan_filter(wanted: DataFrame, rows: int) -> bytes:
    """Bits of a filter over ``rows`` pairs (digest, doc_id), OR-ed in the cluster; FILTER_BITS_MOST come back at most."""
    size = 1 << min(FILTER_BITS_MOST.bit_length() - 1, max(10, (FILTER_BITS_EACH * rows).bit_length()))
    h = F.xxhash64(_entry_key(F.col("digest"), F.col("doc_id")))  # seed 42
    marks = wanted.select(F.explode(F.array(F.pmod(h, F.lit(size)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(size)))).alias("slot"))
    words = marks.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = np.zeros(size // 64, dtype="<i8")
    got = words.toArrow()
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table.tobytes()


def _admitted(bits: bytes, digest_bytes: int):
    """Rows whose digest and id the filter admits."""
    mask = 8 * len(bits) - 1

    def run(batches):
        for batch in batches:
            at, digests, texts = [], [], []
            ids, k = batch.column(0), 0
            names = iter(ids.to_pylist())
            for part in rows_of(batch, 1):
                for text in part:
                    digest, ident = hashlib.sha256(text).digest()[:digest_bytes], next(names)
                    h = xxh64_intdigest(digest + (b"~" if ident is None else b"%d" % ident), seed=42)
                    low, high = h & mask, h >> 32 & mask
                    if bits[low >> 3] >> (low & 7) & 1 and bits[high >> 3] >> (high & 7) & 1:
                        at.append(k), digests.append(digest), texts.append(text)
                    k += 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "digest", "text"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, digest_bytes: int = 32) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``, dropped ones too.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the smallest id
    stays (``largest``: the largest). A null id loses to any other and is kept only if its group has no other.
    Rows that repeat both id and text all count in group_size and share one answer. ``digest_bytes`` (6 at
    least in production) shortens the index's digest; collisions then cost time but never change a result.
    Extra columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    best = F.max if largest else F.min
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    runs = cut(narrow.mapInArrow(_ingest(largest, digest_bytes), "kind byte, doc_id long, digest binary, n long"))
    rows = runs.where(f"kind = {DOC}").select("doc_id", F.col("digest").alias("sha"), F.expr(f"substring(digest, 1, {digest_bytes})").alias("digest"))
    entries = runs.where(f"kind = {ENTRY}")
    merged = entries.groupBy("digest").agg(best("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    hits = cut(merged.where("group_size > 1"))
    # Entries that no byte comparison has reached, with the survivor of their digest.
    loose = runs.where(f"kind <> {DOC}").join(hits, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")) | (F.col("kind") == CHECK))
    checks = loose.select("digest", "doc_id", "keep_id").distinct()
    wanted = cut(checks.select("digest", "doc_id").unionByName(checks.select("digest", F.col("keep_id").alias("doc_id"))).distinct())
    in_question = wanted.count()
    found = narrow.mapInArrow(_admitted(_scan_filter(wanted, in_question), digest_bytes), "doc_id long, digest binary, text binary")
    w = wanted.select(F.col("digest").alias("w_digest"), F.col("doc_id").alias("w_id"))
    texts = found.join(w, (F.col("digest") == F.col("w_digest")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    clashes = cut(texts.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("digest"))
    # Collisions are regrouped by whole texts; every other digest has the index's answer.
    answered = rows.join(hits, "digest", "left").join(clashes, "digest", "left_anti")
    answered = answered.select("doc_id", "sha", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    clashing = rows.join(clashes, "digest", "left_semi").select("doc_id", "sha")
    again = clashing.groupBy("sha").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = answered.unionByName(clashing.join(again, "sha").select("doc_id", "sha", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
