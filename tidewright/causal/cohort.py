"""Windowed aggregates, deciles, the signature universe, and input gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.windows import equal_volume_deciles
from .config import DecileGroups, Study, Window


def windowed_sums(facts: DataFrame, anchors: DataFrame, subject: str, month: str, value: str, measure: str, windows: tuple[Window, ...]) -> DataFrame:
    """``{measure}_{window}`` for each subject of ``anchors`` (subject, reach anchor, last anchor): one pass.

    Components collapse by summing. A subject without rows in a window has 0.0 there; without an anchor, null
    sums become 0.0 too.
    """
    rows = facts.groupBy(subject, month).agg(F.sum(value).alias("__v")).join(anchors, subject, "right")
    exprs = []
    for w in windows:
        offset = F.col(month) - F.col(f"{w.anchor}_anchor")
        exprs.append(F.coalesce(F.sum(F.when(offset.between(w.low, w.high), F.col("__v"))), F.lit(0)).cast("double").alias(f"{measure}_{w.name}"))
    return rows.groupBy(subject).agg(*exprs)


def anchors(subjects: DataFrame, subject: str, reach: str) -> DataFrame:
    """Reach anchor: the subject's month, or the cohort's first; last: the month before the cohort's first; first: month 1."""
    first = subjects.agg(F.min(reach).alias("__first"))
    rows = subjects.join(F.broadcast(first))  # one row
    return rows.select(subject, F.coalesce(reach, "__first").alias("reach_anchor"), (F.col("__first") - 1).alias("last_anchor"), F.lit(1).cast("long").alias("first_anchor"))


def compute_windows(study: Study, subjects: DataFrame, facts: dict[str, DataFrame], reach: str = "reach_month", value: str = "value") -> DataFrame:
    """All windows of all measures, their deciles, and the anchors, one row a subject."""
    at = anchors(subjects, study.subject, reach)
    frames = [windowed_sums(facts[m], at, study.subject, study.month, value, m, study.windows) for m in study.measures]
    out = reduce(lambda a, b: a.join(b, study.subject), frames, at)
    ranked = {f"{m}_{w}": f"{m}_{w}_decile" for m in study.measures for w in study.decile_windows}
    return equal_volume_deciles(out, ranked, study.subject) if ranked else out


def merged_decile(column: Column | str, groups: DecileGroups, measure: str) -> Column:
    """A decile's bucket: the smallest decile of its group; a decile in no group stays."""
    c = F.col(column) if isinstance(column, str) else column
    mapping = groups.mapping(measure)
    if not mapping:
        return c
    out = None
    for d, b in sorted(mapping.items()):
        out = F.when(c == d, F.lit(b)) if out is None else out.when(c == d, F.lit(b))
    return out.otherwise(c)


def signatures(df: DataFrame, columns: tuple[str, ...], reached: str) -> DataFrame:
    """Counts of the reached cohort's signatures, most frequent first."""
    return df.where(F.col(reached) == 1).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns)


def signature_universe(df: DataFrame, columns: tuple[str, ...], reached: str) -> DataFrame:
    """Rows whose signature some reached subject has."""
    seen = df.where(F.col(reached) == 1).select(*columns).distinct()
    return df.join(seen, list(columns), "left_semi")


def input_gates(study: Study, df: DataFrame, reached: str) -> DataFrame:
    """One row: n_reached, n_control, ratio, and whether the study's minimums hold."""
    r, c = F.count_if(F.col(reached) == 1), F.count_if(F.col(reached) == 0)
    ratio = F.try_divide(c.cast("double"), r)
    ok = (r >= study.min_reached) & (c >= study.min_control) & (F.coalesce(ratio, F.lit(0.0)) >= study.min_ratio)
    return df.agg(r.alias("n_reached"), c.alias("n_control"), ratio.alias("ratio"), ok.alias("passed"))


def require_inputs(study: Study, df: DataFrame, reached: str) -> None:
    row = input_gates(study, df, reached).first()
    if not row["passed"]:
        raise ConfigError(f"the cohort misses the study's minimums: {row.asDict()}")
