"""Propensity by logistic regression, and ANCOVA by least squares; rows stay in the cluster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import equal_count_bin, equal_range_bin, quantile_bin
from ..operators.materialize import cut


def levels_of(df: DataFrame, column: str) -> list:
    """Distinct levels in order. A categorical covariate has few of them."""
    return sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(1001).collect())


def one_hot(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, Column]]:
    """A 0/1 column for each level but the first, levels sorted."""
    out = []
    for c in columns:
        levels = levels_of(df, c)
        if len(levels) > 1000:
            raise ValueError(f"{c} has over 1000 levels")
        out += [(f"{c}={v}", F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))) for v in levels[1:]]
    return out


def standardised(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, Column]]:
    """z values with the population deviation, which is 1e-9 at least; nulls are 0 before."""
    if not columns:
        return []
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(*[f for c in columns for f in (F.avg(zero[c]), F.stddev_pop(zero[c]))]).first()
    return [(c, (zero[c] - F.lit(row[2 * k] or 0.0)) / F.lit(max(row[2 * k + 1] or 0.0, 1e-9))) for k, c in enumerate(columns)]


@dataclass
class Logistic:
    names: list[str]
    weights: np.ndarray
    columns: list[Column] = field(repr=False, default_factory=list)
    iterations: int = 0
    cost: float = float("nan")

    def probability(self) -> Column:
        z = sum((F.lit(float(w)) * c for w, c in zip(self.weights[:-1], self.columns)), F.lit(float(self.weights[-1])))
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


#: Feature rows that are fitted on the driver, at most; more are fitted by a pass over their blocks each round.
DRIVER_ROWS = 100_000


def _step(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: their number, the loss, and the gradient."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
    safe = np.clip(p, 1e-15, 1 - 1e-15)
    return np.concatenate([[len(y), -(y * np.log(safe) + (1 - y) * np.log(1 - safe)).sum()], x.T @ (p - y)])


def fit_logistic(df: DataFrame, label: str, features: list[tuple[str, Column]], rate: float = 0.1, rounds: int = 200, tolerance: float = 1e-6, driver_rows: int = DRIVER_ROWS) -> Logistic:
    """Full-batch gradient descent from zero weights, the bias last; stops when the cost moves less than ``tolerance``.

    Up to ``driver_rows`` rows of features come to the driver. Beyond that each round is one Arrow pass over the
    checkpointed rows, which sums up a block at a time and returns a row a task; weights travel as data, so the plan of
    a round is never compiled anew. Both take the same steps.
    """
    names, columns = [n for n, _ in features], [c for _, c in features]
    size = len(columns) + 1
    rows = cut(df.select(F.col(label).cast("double").alias("y"), F.array(*columns, F.lit(1.0)).alias("x")))

    def arrays(y: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), y.to_numpy(zero_copy_only=False)

    if rows.limit(driver_rows + 1).count() <= driver_rows:
        got = rows.toArrow().combine_chunks()
        held = arrays(got.column(0).combine_chunks(), got.column(1).combine_chunks()) if len(got) else (np.zeros((0, size)), np.zeros(0))
        total = lambda w: _step(*held, w)
    else:

        def total(w: np.ndarray) -> np.ndarray:
            def run(batches):
                sums = np.zeros(size + 2)
                for batch in batches:
                    sums += _step(*arrays(batch.column(0), batch.column(1)), w)
                yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

            return np.sum([r[0] for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)  # a row a task

    w, before, cost, k = np.zeros(size), None, float("nan"), 0
    for k in range(1, rounds + 1):
        n, loss, *gradient = total(w)
        if not n:
            break
        cost, w = loss / n, w - rate * np.array(gradient) / n
        if before is not None and abs(before - cost) < tolerance:
            break
        before = cost
    return Logistic(names, w, columns, k, cost)


def attach_bins(df: DataFrame, score: str, subject: str, out: str, bins: int = 10, how: str = "equal_count") -> DataFrame:
    """Propensity bins: equal_count, equal_range or quantile."""
    if how == "equal_range":
        return df.withColumn(out, equal_range_bin(score, bins))
    return (quantile_bin if how == "quantile" else equal_count_bin)(df, score, subject, out, bins)


@dataclass
class Fit:
    """Least squares of one outcome; ``skipped`` says why there is none."""

    outcome: str
    names: list[str]
    beta: np.ndarray | None = None
    se: np.ndarray | None = None
    n: int = 0
    stats: dict = field(default_factory=dict)
    skipped: str | None = None

    @property
    def t(self) -> np.ndarray | None:
        return None if self.beta is None or self.se is None else self.beta / self.se


def least_squares(df: DataFrame, outcome: str, features: list[tuple[str, Column]]) -> Fit:
    """Intercept and features by normal equations. X'X and X'y are one aggregate of p * (p + 3) / 2 + 1 sums.

    A singular system or one with no more rows than columns is reported as skipped, not dropped silently.
    """
    names = ["intercept", *[n for n, _ in features]]
    cols = [F.lit(1.0), *[c.cast("double") for _, c in features]]
    p = len(cols)
    flat = df.select(F.array(*cols).alias("x"), F.col(outcome).cast("double").alias("y")).where(F.col("y").isNotNull())
    x = [F.col("x")[i] for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = flat.agg(F.count("*"), F.sum(F.col("y") * F.col("y")), *[F.sum(x[i] * F.col("y")) for i in range(p)], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    n = row[0]
    if n <= p:
        return Fit(outcome, names, n=n, skipped=f"{n} rows for {p} columns")
    xty = np.array(row[2 : 2 + p], dtype=float)
    xtx = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[2 + p :]):
        xtx[i, j] = xtx[j, i] = v
    scale = np.sqrt(np.diag(xtx))
    if (scale == 0).any() or np.linalg.cond(xtx / np.outer(scale, scale)) > 1e12:
        return Fit(outcome, names, n=n, skipped="the columns depend on each other")
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    residual = max(0.0, float(row[1] - beta @ xty))
    return Fit(outcome, names, beta, np.sqrt(np.diag(inverse) * residual / (n - p)), n)


def ancova(df: DataFrame, outcome: str, treatment: str, baseline: str, covariates: Sequence[str] = (), categorical: Sequence[str] = ()) -> Fit:
    """Outcome on treatment, baseline, covariates and dummies, with group means and lift in percent."""
    features = [(treatment, F.col(treatment)), (baseline, F.col(baseline)), *[(c, F.col(c)) for c in covariates], *one_hot(df, categorical)]
    fit = least_squares(df, outcome, features)
    on = lambda k: F.when(F.col(treatment) == k, F.col(outcome))
    row = df.agg(F.avg(on(1)), F.stddev_samp(on(1)), F.avg(on(0)), F.stddev_samp(on(0))).first()
    lift = None if not row[2] else (row[0] - row[2]) / row[2] * 100 if row[0] is not None else None
    fit.stats = {"test_mean": row[0], "test_sd": row[1], "control_mean": row[2], "control_sd": row[3], "lift_pct": lift}
    return fit
