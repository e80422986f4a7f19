"""Line dedup: lines found in many documents, as compressed keep bitmaps for each document.

Each document is split at \\n. A line's key is the line without ASCII white space at its ends, A-Z in lower
case; it travels as a 128-bit hash with the document's own 128-bit key and the positions, one record for each
distinct key of a document. Records are range-partitioned by (hash, document) and sorted, so one task streams
over a hash's documents in order, and a line that very many documents share is split over several tasks. Only
a hash at the edge of a task can go on in the next one; what tasks saw of their edge hashes is added up in a
small table of two rows a task.

Streaming emits (document, positions to drop). These are gathered for each document into a bitmap of the lines
to keep; texts take no part until the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import WHITE, bound_batches, cut, rows_of, utf8


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that tell documents apart: id and text. Rows that repeat both are one document."""
    return F.concat(*[F.to_binary(F.lpad(F.hex(F.xxhash64(F.lit(s), F.col(id_col), F.col(text_col))), 16, "0"), F.lit("hex")) for s in (1, 2)])


def compress(keep: np.ndarray) -> bytes:
    """Bitmap of kept lines, as packed bits under zlib, behind the number of lines."""
    return len(keep).to_bytes(8, "little") + zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def expand(bitmap: bytes) -> np.ndarray:
    n = int.from_bytes(bitmap[:8], "little")
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[8:]), dtype=np.uint8), bitorder="little")[:n].astype(bool)


def _records(min_chars: int):
    """(line hash, document, positions as little-endian 32-bit integers), sorted by hash within a document."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            docs = batch.column(0).to_pylist()
            k, at, lines, where = 0, [], [], []
            for part in rows_of(batch, 1):
                for text in part:
                    own: dict[bytes, list[int]] = {}
                    for pos, line in enumerate(text.split(b"\n")):
                        key = line_key(line)
                        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                            own.setdefault(key, []).append(pos)
                    for key, positions in own.items():
                        at.append(docs[k]), lines.append(xxh3_128_digest(key)), where.append(np.array(positions, dtype="<u4").tobytes())
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(at, pa.binary()), pa.array(where, pa.binary())], names=["line", "doc", "positions"])

    return run


def _edges(batches):
    """First and last hash of a task, with the documents that it has of each there."""
    first: list | None = None
    last: list = [None, 0]
    doc_before = None
    for batch in batches:
        for line, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if line != last[0]:
                last = [line, 0]
                first = first or last
            elif doc == doc_before:
                continue
            last[1] += 1
            doc_before = doc
    if first:
        found = [first] if first is last else [first, last]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.binary()), pa.array([r[1] for r in found], pa.int64())], names=["line", "n"])


def _dropped(min_docs: int, keep_first: bool):
    """Positions to drop, streamed: rows of a hash wait only until it is known to have ``min_docs``.

    ``total``: documents over all tasks, for a hash at an edge; ``goes_on``: an earlier task has some of them.
    """
    def run(batches):
        last = before = total = None
        n, waiting = 0, []
        for batch in batches:
            docs, where = [], []
            for line, doc, positions, all_tasks, goes_on in zip(*(c.to_pylist() for c in batch.columns)):
                if line != last:
                    last, before, n, waiting, total, first = line, None, 0, [], all_tasks, not goes_on
                if doc == before:
                    continue
                before, n = doc, n + 1
                drop = positions[4:] if keep_first and first and n == 1 else positions
                if n >= min_docs or (total or 0) >= min_docs:
                    for d, p in [*waiting, (doc, drop)]:
                        if p:
                            docs.append(d), where.append(p)
                    waiting = []
                else:
                    waiting.append((doc, drop))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), pa.array(where, pa.binary())], names=["doc", "positions"])

    return run


def drop_positions(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc binary, positions array<binary>)`` for each document that has lines to drop.

    Lines whose key has ``min_chars`` code points and is found in ``min_docs`` documents go, in all of them, or
    (``keep_first``) all but the first one by document key and position.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(doc_key(id_col, text_col).alias("doc"), utf8(text_col).alias("text")).where(F.length("text") > 0)
    records = cut(keyed.mapInArrow(_records(min_chars), "line binary, doc binary, positions binary"))
    ordered = cut(records.repartitionByRange(parts, "line", "doc").sortWithinPartitions("line", "doc").withColumn("part", F.spark_partition_id()))
    seen = ordered.select("line", "doc").mapInArrow(_edges, "line binary, n long").withColumn("part", F.spark_partition_id())
    edges = seen.groupBy("line").agg(F.sum("n").alias("total"), F.min("part").alias("first_part"))
    # Two rows a task: bounded by the number of tasks, not by the data.
    streamed = ordered.join(F.broadcast(edges), "line", "left").select("line", "doc", "positions", "total", F.coalesce(F.col("part") > F.col("first_part"), F.lit(False)))
    dropped = streamed.mapInArrow(_dropped(min_docs, keep_first), "doc binary, positions binary")
    return dropped.groupBy("doc").agg(F.collect_list("positions").alias("positions"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc, n_lines, n_dropped, bitmap)``: a compressed bitmap of kept lines for each document row.

    A null or empty text is one empty line. Rows that repeat id and text count as one document and get the
    same bitmap. An empty table gives no rows; extra columns are ignored.
    """
    dropped = drop_positions(docs, min_docs, min_chars, keep_first, id_col, text_col)
    lines = (F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit("\n")) + 1).cast("long").alias("n_lines")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_key(id_col, text_col).alias("doc"), lines)

    def run(batches):
        for batch in batches:
            gone, maps = [], []
            for n, positions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n, dtype=bool)
                for p in positions or ():
                    keep[np.frombuffer(p, dtype="<u4")] = False
                gone.append(n - int(keep.sum())), maps.append(compress(keep))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(gone, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "doc", "n_lines", "n_dropped", "bitmap"])

    return narrow.join(dropped, "doc", "left").select("doc_id", "doc", "n_lines", "positions").mapInArrow(run, "doc_id long, doc binary, n_lines long, n_dropped long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, joined by \n, and ``n_lines``, ``n_dropped``.

    Null texts without dropped lines stay null. Columns named n_lines or n_dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    maps = bitmaps.select("doc", "n_lines", "n_dropped", "bitmap").dropDuplicates(["doc"]).withColumnRenamed("doc", "__doc")

    @F.pandas_udf("string")
    def kept_lines(texts, maps):
        import pandas as pd

        return pd.Series(["\n".join(x for x, k in zip(t.split("\n"), expand(m)) if k) if t is not None and m is not None else t for t, m in zip(texts, maps)], dtype=object)

    joined = docs.select(*[F.col(f"`{c}`") for c in kept], doc_key(id_col, text_col).alias("__doc")).join(maps, "__doc", "left")
    texts = kept_lines(F.col(f"`{text_col}`"), F.when(F.col("n_dropped") > 0, F.col("bitmap")))
    return joined.select(*[texts.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], "n_lines", "n_dropped")
