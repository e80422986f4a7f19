"""Time series by group, dashboard cross-tabs, and the export set."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import index_to_month
from ..functions.windows import histogram_bin
from ..operators.materialize import write_text
from ..sources.bind import write


def group_labels(matches: DataFrame, subject: str) -> DataFrame:
    """(subject, group): test or control, each subject once; a test that is also a control counts as test."""
    sides = matches.select(F.explode(F.array(F.struct(F.col(f"test_{subject}").alias("s"), F.lit("test").alias("g")), F.struct(F.col(f"control_{subject}").alias("s"), F.lit("control").alias("g")))).alias("x"))
    return sides.groupBy(F.col("x.s").alias(subject)).agg(F.max("x.g").alias("group"))


def time_series(facts: dict[str, DataFrame], groups: DataFrame, subject: str, month: str, value: str = "value") -> DataFrame:
    """Mean, deviation and count of monthly values, for test, control and the whole universe."""
    out = None
    for measure, df in facts.items():
        monthly = df.groupBy(subject, month).agg(F.sum(value).alias("v"))
        labelled = monthly.join(groups, subject, "left")
        both = labelled.select(month, "v", F.explode(F.array_compact(F.array(F.col("group"), F.lit("universe")))).alias("group"))
        part = both.groupBy("group", F.col(month).alias("month")).agg(F.avg("v").alias("mean_value"), F.coalesce(F.nanvl(F.stddev_samp("v"), F.lit(0.0)), F.lit(0.0)).alias("sd_value"), F.count("v").alias("n_value")).select(F.lit(measure).alias("measurement"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def pre_post(series: DataFrame, reach: int, months: int = 6) -> DataFrame:
    """Difference in differences of monthly group means: ``months`` before and after month ``reach``."""
    on = lambda g, low, high: F.avg(F.when((F.col("group") == g) & F.col("month").between(low, high), F.col("mean_value")))
    before, after = (reach - months, reach - 1), (reach, reach + months - 1)
    cells = series.groupBy("measurement").agg(on("test", *before).alias("test_pre"), on("test", *after).alias("test_post"), on("control", *before).alias("control_pre"), on("control", *after).alias("control_post"))
    did = (F.col("test_post") - F.col("test_pre")) - (F.col("control_post") - F.col("control_pre"))
    return cells.withColumns({"did": did, "did_pct": F.try_divide(did * 100, F.col("control_post"))})


def decile_funnel(df: DataFrame, decile: str, flags: dict[str, str]) -> DataFrame:
    """By decile: rows, and rows with each flag set."""
    return df.groupBy(decile).agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 1).alias(name) for name, c in flags.items()])


def decile_crosstab(df: DataFrame, row: str, column: str, value: str | None = None, levels: range = range(0, 11)) -> DataFrame:
    """Rows by decile, a column for each decile: counts, or mean ``value``."""
    cell = lambda d: F.avg(F.when(F.col(column) == d, F.col(value))) if value else F.count_if(F.col(column) == d)
    return df.groupBy(row).agg(*[cell(d).alias(f"d{d}") for d in levels])


def state_crosstab(df: DataFrame, decile: str) -> DataFrame:
    """called_on x reached x decile counts with all totals (nulls mark a total)."""
    return df.cube("called_on", "reached", decile).agg(F.count("*").alias("n"))


def score_histogram(df: DataFrame, score: str, bins: int = 5) -> DataFrame:
    """Equal-width bins of a score from its minimum to its maximum."""
    bounds = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    binned = df.join(F.broadcast(bounds)).select(histogram_bin(score, F.col("__lo"), F.col("__hi"), bins).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def match_rate(tests: DataFrame, matches: DataFrame, subject: str, by: str) -> DataFrame:
    """Share of tests that found a control, by a column."""
    hits = matches.select(F.col(f"test_{subject}").alias(subject)).distinct().withColumn("hit", F.lit(1))
    rows = tests.select(subject, by).join(hits, subject, "left")
    return rows.groupBy(by).agg(F.count("*").alias("tests"), F.count("hit").alias("matched"), F.try_divide(F.count("hit").cast("double"), F.count("*")).alias("rate"))


def sum_by_subject(df: DataFrame, subject: str, value: str) -> DataFrame:
    return df.groupBy(subject).agg(F.sum(value).alias("total"))


def waterfall(df: DataFrame, matches: DataFrame, subject: str) -> DataFrame:
    """One row: subjects, in universe, reached, matched tests, distinct controls."""
    counts = df.agg(F.count("*").alias("subjects"), F.count_if(F.col("in_universe") == 1).alias("in_universe"), F.count_if(F.col("reached") == 1).alias("reached"))
    pairs = matches.agg(F.count("*").alias("matched"), F.count_distinct(f"control_{subject}").alias("controls"))
    return counts.join(F.broadcast(pairs))  # one row each


def target_list(subjects: DataFrame, subject: str, reach: str, first_year: int, first_month: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """Planned reach months as YYYY-MM."""
    return subjects.where(F.col(reach).isNotNull()).select(subject, *columns, index_to_month(reach, first_year, first_month).alias("planned_reach_date"))


def export(folder: str, frames: dict[str, DataFrame], summary: dict, config: dict | None = None, fits: list | None = None, configs: dict[str, str] | None = None) -> None:
    """CSV tables; JSON for the summary, the fits and the parsed configuration; copies of the configuration's files.

    Everything goes through Spark's file systems, so that ``folder`` may lie in any store.
    """
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        write(df, f"{folder}/{name}.csv", "csv")
    rows = [{"outcome": f.outcome, "n": f.n, "skipped": f.skipped, **f.stats, "terms": [] if f.beta is None else [{"name": n, "beta": float(b), "se": float(s), "t": float(b / s) if s else None} for n, b, s in zip(f.names, f.beta, f.se)]} for f in fits or []]
    for name, content in (("summary", summary), ("ancova", rows), ("config", config or {}), ("cfg-parsed", {n: tomllib.loads(t) for n, t in (configs or {}).items() if n.endswith(".toml")})):
        write_text(spark, f"{folder}/{name}.json", json.dumps(content, indent=2, default=str))
    for name, text in (configs or {}).items():
        write_text(spark, f"{folder}/{name}", text)
