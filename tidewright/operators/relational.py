"""Unions, dedup, component crushes, filters and synthetic subjects."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BindingError, RequestError
from ..functions.aggregates import aggregate
from ..model import Aggregate, SubjectFilter, SyntheticSubject, TimeRange


def crush(df: DataFrame, keys: Sequence[str], values: dict[str, Aggregate | str], components: Sequence[str] = ()) -> DataFrame:
    """One row for each key: components not among the keys are aggregated away. first and last go by component."""
    level = F.struct(*[F.col(c) for c in components]) if components else None
    return df.groupBy(*keys).agg(*[aggregate(v, how, level, level).alias(v) for v, how in values.items()])


def expand(grid: DataFrame, df: DataFrame, keys: Sequence[str], components: Sequence[str]) -> DataFrame:
    """``df`` on every grid cell, one series for each combination of components that a subject has (no crush)."""
    subject = [k for k in keys if k in df.columns][:1]
    series = df.select(*subject, *components).distinct()
    return grid.join(series, subject).join(df, [*keys, *components], "left")


def stack(frames: Sequence[DataFrame], keys: Sequence[str], value: str, components: Sequence[str], how: Aggregate | str, overlap: str = "keep_all", priorities: Sequence[int] | None = None) -> DataFrame:
    """Union of fragments. Components that some fragment lacks are crushed in the others first.

    ``overlap`` settles rows that two fragments have at one key, as in ``dedup``.
    """
    shared = [c for c in components if all(c in f.columns for f in frames)]
    parts = []
    for f in frames:
        extra = [c for c in components if c in f.columns and c not in shared]
        cut = crush(f, [*keys, *shared], {value: how}, extra) if extra else f
        parts.append(cut.select(*keys, *shared, value))
    if overlap == "keep_all":
        return reduce(lambda a, b: a.unionByName(b), parts)
    order = priorities or range(len(parts))
    return dedup({str(k): p for k, p in enumerate(parts)}, [*keys, *shared], overlap, {str(k): o for k, o in enumerate(order)}, tie=value)


def dedup(frames: dict[str, DataFrame], keys: Sequence[str], policy: str = "first_wins", priorities: dict[str, int] | None = None, tie: str | None = None, tag: str | None = None) -> DataFrame:
    """Union of named sources with one row for each key: first_wins or last_wins by priority, keep_all, or error.

    ``tag`` names a column for the source. Rows of one source at one key are settled by ``tie``.
    """
    order = priorities or {name: k for k, name in enumerate(frames)}
    parts = [f.withColumns({"__prio": F.lit(order[name]), "__source": F.lit(name)}) for name, f in frames.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if policy in ("first_wins", "last_wins"):
        ends = [F.col("__prio"), *([F.col(tie)] if tie else [])]
        w = Window.partitionBy(*keys).orderBy(*[c.asc() if policy == "first_wins" else c.desc() for c in ends])
        rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    elif policy == "error":
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise BindingError(f"sources overlap on {list(keys)}")
    elif policy != "keep_all":
        raise RequestError(f"unknown dedup policy: {policy}")
    return (rows.withColumnRenamed("__source", tag) if tag else rows.drop("__source")).drop("__prio")


def filter_subjects(df: DataFrame, subject: str, by: SubjectFilter | None) -> DataFrame:
    if by is None:
        return df
    if by.include:
        df = df.where(F.col(subject).isin(*by.include))
    return df.where(~F.col(subject).isin(*by.exclude)) if by.exclude else df


def filter_time(df: DataFrame, time: str, span: TimeRange | None, with_end: bool = False) -> DataFrame:
    """start <= t < end, or t <= end."""
    if span is None:
        return df
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    if span.start is not None:
        df = df.where(F.col(time) >= at(span.start))
    if span.end is None:
        return df
    return df.where(F.col(time) <= at(span.end) if with_end else F.col(time) < at(span.end))


def filter_levels(df: DataFrame, filters: dict[str, dict]) -> DataFrame:
    """Component levels: {component: {"include": [...]} or {"exclude": [...]}}; an empty dict keeps all."""
    for component, by in filters.items():
        if by.get("include"):
            df = df.where(F.col(component).isin(*by["include"]))
        if by.get("exclude"):
            df = df.where(~F.col(component).isin(*by["exclude"]))
    return df


def synthetic_name(spec: SyntheticSubject) -> Column:
    """The name with its marks filled in; grouped without a mark, the group's values are put behind it."""
    group = [*spec.group_by, *([spec.by_component] if spec.by_component else [])]
    marks = {"{" + g + "}": g for g in group}
    marks |= {"{quality}": spec.group_by[0]} if spec.group_by else {}
    marks |= {"{component}": spec.by_component} if spec.by_component else {}
    parts = [x for x in re.split("(" + "|".join(map(re.escape, marks)) + ")", spec.name) if x] if marks else [spec.name]
    if not any(x in marks for x in parts):
        parts += [x for g in group for x in ("_", "{" + g + "}")]
    return F.concat(*[F.col(marks[x]).cast("string") if x in marks else F.lit(x) for x in parts])


def synthetic_rows(df: DataFrame, spec: SyntheticSubject, subject: str, time: str, values: dict[str, Aggregate]) -> DataFrame:
    """Rows of a synthetic subject: the values of all subjects aggregated at each time [and value of a quality or component]."""
    group = [*spec.group_by, *([spec.by_component] if spec.by_component else [])]
    how = lambda v, d: spec.rules.get(v, d if spec.default is Aggregate.AUTO else spec.default)
    rows = df.groupBy(time, *group).agg(*[aggregate(v, how(v, d), F.col(subject)).alias(v) for v, d in values.items()])
    return rows.withColumn(subject, synthetic_name(spec))


def add_synthetic(df: DataFrame, specs: Sequence[SyntheticSubject], subject: str, time: str, values: dict[str, Aggregate]) -> DataFrame:
    """``df`` and the rows of its synthetic subjects; columns that these lack are null."""
    out = df.withColumn(subject, F.col(subject).cast("string"))
    for spec in specs:
        out = out.unionByName(synthetic_rows(df, spec, subject, time, values), allowMissingColumns=True)
    return out


def top_by_count(df: DataFrame, *keys: str) -> DataFrame:
    """Row counts of each key, largest first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *keys)


def coverage_gaps(grid: DataFrame, data: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Grid cells without data, and data off the grid."""
    return grid.join(data, list(keys), "left_anti"), data.join(grid, list(keys), "left_anti")
