"""Statistics of whole documents: exact base counts, and ratios that do not depend on language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bound_batches, rows_of, utf8

#: What the base counts call symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the models, in order.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "exclaim_share",
    "stop_share", "comma_share", "other_punct_share", "non_ascii_share", "distinct_share", "words_per_line", "capital_words", "symbol_words", "longest_word", "line_count",
)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs at least twice, the first time included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rolling = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        rolling ^= rolling >> np.uint64(29)
    order = np.argsort(rolling, kind="stable")
    same = np.flatnonzero(rolling[order[1:]] == rolling[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), dtype=bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    if equal.all():
        at = np.union1d(a, b)
    else:  # two windows share a hash: number the windows exactly
        key = ids[:n].astype(np.int64)
        for k in range(1, window):
            key = np.unique(key * (int(ids.max()) + 1) + ids[k : k + n], return_inverse=True)[1]
        at = np.flatnonzero(np.bincount(key)[key] > 1)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Base counts and model inputs of one UTF-8 text."""
    words = text.split()
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    repeats = repeat_words(ids)
    dup_lines = len(lines) - len(set(lines))
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = int(count[:0x80].sum() + count[0xC0:].sum())  # code points: continuation bytes don't count
    white = int(count[9:14].sum() + count[32])
    symbols = int(count[list(SYMBOLS)].sum())
    base = [n, chars - white, symbols, dup_lines, repeats]
    upper, digits, exclaim = int(count[65:91].sum()), int(count[48:58].sum()), int(count[33])
    punct = int(count[34] + count[39:42].sum() + count[43] + count[45] + count[47] + count[58:60].sum() + count[61] + count[63:65].sum() + count[91:97].sum() + count[123] + count[125:127].sum())
    non_ascii = int(count[0xC0:].sum())
    letters = max(1, chars - white)
    kinds = max(1, len(known))
    capital = sum(w.isupper() for w in known) / kinds
    odd = sum(w[-1] in SYMBOLS or w[-1] == 33 for w in known) / kinds
    feats = [
        float(np.log1p(n)), base[1] / max(1, n), symbols / letters, dup_lines / max(1, len(lines)), repeats / max(1, n), upper / letters, digits / letters, exclaim / letters,
        int(count[46]) / max(1, n), int(count[44]) / max(1, n), punct / letters, non_ascii / letters, len(known) / max(1, n) ** 0.8, n / max(1, len(lines)), capital, odd, float(np.log1p(max(map(len, known), default=0))), float(np.log1p(len(lines))),
    ]
    return base, feats


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, <base counts>, features array<double>)`` for each row; null text counts as empty."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            base, feats = [], []
            for part in rows_of(batch, 1):
                for text in part:
                    b, f = statistics(text)
                    base.append(b), feats.append(f)
            columns = [pa.array(c, pa.int64()) for c in zip(*base)] if base else [pa.array([], pa.int64())] * len(BASE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(feats, pa.list_(pa.float64()))], names=["doc_id", *BASE, "features"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, schema)
