"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

Features are whole words, their beginnings and character 5-grams, hashed. Those most associated with
the labels (chi-square over the labelled sample) are kept. P(grade >= k) = sigmoid(w . x - t_k): all thresholds
share the weights, and the expected severity is the sum of these probabilities over k.

Labels only say toxic or not. Toxic rows of the sample get grades 1 to 3 by terciles of how many of their words
carry a feature that toxic rows favour. So grades 2 and 3 measure an amount that the model's own features found, and
only the step from 0 to 1 is learned from what people marked.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, cut, rows_of, utf8
from .quality import fold

#: Bounds of the fit: labelled rows of each class, features kept; hashed feature space.
MAX_EACH, MAX_FEATURES, SPACE = 4000, 1024, 1 << 20
GRADES = 3
PUNCTUATION = b".,;:!?*#$%&()[]{}\"'|<>-_/\\`~^+=@"
CACHE = 1 << 18


def features_of(word: bytes) -> set[int]:
    """Hashed features of a word in lower case without outer punctuation: itself, its beginnings, its 5-grams."""
    w = b"^" + word.strip(PUNCTUATION) + b"$"
    grams = {w, *(w[:k] for k in range(4, min(len(w), 10))), *(w[k : k + 5] for k in range(1, len(w) - 4))}
    return {crc32(g) % SPACE for g in grams}


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordFeatures(dict):
    """Word -> number; the kept features of a numbered word lie in ``flat[start[n] : start[n + 1]]``. 0: it has none."""

    def __init__(self, slots: dict[int, int]):
        super().__init__()
        self.slots, self.found, self.ends = slots, [], [0, 0]
        self.start, self.flat = np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __missing__(self, word: bytes) -> int:
        kept = [self.slots[s] for s in features_of(word) if s in self.slots]
        number = len(self.ends) - 1 if kept else 0
        if kept:
            self.found += kept
            self.ends.append(len(self.found))
        self[word] = number
        return number

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each of these words, one after the other, and how many each has."""
        if len(self.start) < len(self.ends):
            self.start, self.flat = np.array(self.ends, dtype=np.int64), np.array(self.found, dtype=np.int64)
        size = self.start[numbers + 1] - self.start[numbers]
        first = np.repeat(self.start[numbers] - np.cumsum(size) + size, size)
        return self.flat[first + np.arange(len(first))], size


@dataclass
class OrdinalModel:
    """slots: feature numbers; weights to them; thresholds in rising order (none: everything is grade 0)."""

    slots: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray
    words: WordFeatures | None = field(default=None, repr=False, compare=False)

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse log1p counts of the kept features: text number, feature, value."""
        if self.words is None or len(self.words) >= CACHE:
            self.words = WordFeatures(self.slots)
        hits = []
        for text in texts:
            numbers = np.fromiter(map(self.words.__getitem__, words_of(text)), dtype=np.int64)
            hits.append(numbers[numbers > 0])
        rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        features, size = self.words.expand(np.concatenate(hits) if hits else np.zeros(0, dtype=np.int64))
        width = max(1, len(self.slots))
        cell, times = np.unique(np.repeat(rows, size) * width + features, return_counts=True)
        return cell // width, cell % width, np.log1p(times)

    def at_least(self, n: int, sparse) -> np.ndarray:
        """P(grade >= k) for n texts, a column for each k from 1."""
        rows, cols, values = sparse
        dot = np.bincount(rows, self.weights[cols] * values, minlength=n)[:n] if len(rows) else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(dot[:, None] - self.thresholds[None, :], -30, 30)))


def ordinal_loss(params: np.ndarray, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, grades: int, share: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood of the cumulative links, and its gradient.

    ``params``: the weights, the first threshold, and the logs of the steps to the next ones. ``x``: row, column and
    value of what isn't zero.
    """
    at_row, at_col, value = x
    size, rows = len(params) - grades, np.arange(len(y))
    w, first, steps = params[:size], params[size], params[size + 1 :]
    cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
    dot = np.bincount(at_row, w[at_col] * value, minlength=len(y))
    s = 1 / (1 + np.exp(-np.clip(dot[:, None] - cuts[None, :], -30, 30)))
    edge = np.concatenate([np.ones((len(y), 1)), s, np.zeros((len(y), 1))], axis=1)
    p = np.maximum(edge[rows, y] - edge[rows, y + 1], 1e-9)
    slope = np.concatenate([np.zeros((len(y), 1)), s * (1 - s), np.zeros((len(y), 1))], axis=1)
    up, down = slope[rows, y] / p, slope[rows, y + 1] / p
    g_margin = -(up - down) * share
    g_cut = np.zeros(grades + 2)
    np.add.at(g_cut, y, up * share)
    np.add.at(g_cut, y + 1, -down * share)
    tail = np.cumsum(g_cut[1:-1][::-1])[::-1]
    grad = np.concatenate([np.bincount(at_col, g_margin[at_row] * value, minlength=size) + ridge * w, [tail[0]], tail[1:] * np.exp(steps)])
    return float(-(share * np.log(p)).sum() + ridge / 2 * (w**2).sum()), grad


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by full-batch Adam on the cumulative-link likelihood; ``weight`` counts each row so often."""
    share = (np.ones(len(y)) if weight is None else weight) / max(1, len(y) if weight is None else weight.sum())
    size = x.shape[1]
    params = np.concatenate([np.zeros(size), [2.0], np.zeros(max(0, grades - 1))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    at_row, at_col = np.nonzero(x)  # few features are in any text
    sparse = at_row, at_col, x[at_row, at_col].astype(float)
    for t in range(1, rounds + 1):
        grad = ordinal_loss(params, sparse, y, grades, share, ridge)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:size], params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_each: int = MAX_EACH, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fit on whole texts of labelled rows outside fold 1: ``max_each`` of each class, by smallest id hash.

    Sampled rows are weighted back to their class's labelled rows, so the decision does not drift with table size.
    Of documents that share a labelled id one counts (that of the least text hash), so ``max_each`` also bounds what
    comes to the driver. No labelled document, or one class only: a model that calls nothing toxic.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & (fold() != 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("y in (0, 1) and doc_id is not null").distinct()
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [bounded_sample(known.where(F.col("y") == c), max_each) for c in (0, 1)]
    chosen = cut(chosen[0].unionByName(chosen[1]).distinct())  # 2 * max_each rows at most: safe to broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            slots = []
            for part in rows_of(batch, 2):
                for text in part:
                    count: Counter = Counter()
                    for word, times in Counter(words_of(text)).items():
                        for s in features_of(word):
                            count[s] += times
                    slots.append((list(count.keys()), list(count.values())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array([s for s, _ in slots], pa.list_(pa.int32())), pa.array([c for _, c in slots], pa.list_(pa.int32()))], names=["y", "doc_id", "tie", "slots", "times"])

    found = sample.select("y", "doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "y int, doc_id long, tie long, slots array<int>, times array<int>")
    one = found.groupBy("y", "doc_id").agg(F.min(F.struct("tie", "slots", "times")).alias("r"))
    rows = cut(one.select("y", "r.slots", "r.times"))
    n1, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not 0 < n1 < n:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    seen = rows.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    gap = F.col("a") * n - F.col("b") * n1
    chi = (gap * gap * n) / (F.col("b") * (n - F.col("b")) * float(n1) * float(n - n1))
    best = seen.where((F.col("b") < n) & (F.col("b") >= 3)).select("slot", "a", "b", chi.alias("chi")).where(F.col("chi") > 10).orderBy(F.col("chi").desc(), "slot").limit(max_features).collect()
    slots = {r["slot"]: k for k, r in enumerate(best)}
    favoured = np.array([r["a"] * n > r["b"] * n1 for r in best], dtype=bool)
    wanted = np.array(sorted(slots), dtype=np.int32)

    def kept(batches):
        for batch in batches:
            found = []
            for slot, times in zip(batch.column(1), batch.column(2)):
                slot, times = (x.values.to_numpy() for x in (slot, times))
                at = np.isin(slot, wanted)
                found.append((slot[at], times[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))], names=["y", "slots", "times"])

    got = rows.mapInArrow(kept, "y int, slots array<int>, times array<int>").collect()
    x = np.zeros((len(got), len(slots)), dtype=np.float32)
    for k, r in enumerate(got):
        for slot, times in zip(r["slots"], r["times"]):
            x[k, slots[slot]] = times
    toxic = np.array([r["y"] for r in got], dtype=np.int64)
    amount = x[:, favoured].sum(axis=1)
    cuts = np.quantile(amount[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    y = toxic * (1 + (amount[:, None] > cuts[None, :]).sum(axis=1))
    each = np.array([max(1.0, counted[c] / max_each) for c in (0, 1)])
    weights, thresholds = fit_ordinal(np.log1p(x), y, GRADES, weight=each[toxic])
    return OrdinalModel(slots, weights, thresholds)


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with ``expected_severity`` (0 to 3), ``p_toxic``, ``grade`` (most likely) and ``toxic``.

    Columns of these names are replaced, others pass through. Null and empty texts hold no feature and are not
    toxic unless the labels say that most documents are. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("expected_severity", "p_toxic", "grade", "toxic")]

    @F.pandas_udf("expected_severity double, p_toxic double, grade int")
    def score(texts):
        import pandas as pd

        out = []
        for start in range(0, len(texts), 256):
            part = texts.iloc[start : start + 256]
            p = model.at_least(len(part), model.counts(part))
            edge = np.concatenate([np.ones((len(part), 1)), p, np.zeros((len(part), 1))], axis=1)
            out.append(pd.DataFrame({"expected_severity": p.sum(axis=1), "p_toxic": p[:, 0] if p.shape[1] else 0.0, "grade": (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype("int32")}))
        return pd.concat(out) if out else pd.DataFrame({"expected_severity": [], "p_toxic": [], "grade": []})

    scored = docs.select(*[F.col(f"`{c}`") for c in kept], score(utf8()).alias("__s"))
    return scored.select(*[F.col(f"`{c}`") for c in kept], "__s.expected_severity", "__s.p_toxic", "__s.grade", (F.col("__s.p_toxic") >= 0.5).alias("toxic"))
