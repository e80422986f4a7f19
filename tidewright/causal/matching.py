"""Gated matching of controls to tests, with replacement, and checks of the match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators.materialize import cut
from .cohort import merged_decile
from .config import Study, VolumeGate


def measure_of(column: str) -> str:
    return column.split("_", 1)[0]


def _cells(study: Study, df: DataFrame, columns: Sequence[Column], spread: bool, propensity: str = "propensity_decile") -> tuple[DataFrame, list[str]]:
    """``columns`` with the gates' keys ``__e*`` and ``__g*``; rows without a key match nobody and go.

    A volume gate of distance 0 is a key like the others. One of distance k is one too: with ``spread`` a row is
    repeated for the 2k + 1 buckets that it accepts, so joins stay equi joins and skew can be split.
    """
    equal = [*study.gates, *([propensity] if study.propensity_gate else [])]
    if not equal and not study.volume_gates:
        raise ConfigError("matching needs at least one gate")
    bucket = lambda g: merged_decile(g.column, study.groups, measure_of(g.column)).cast("long")
    keys = [f"__e{k}" for k in range(len(equal))] + [f"__g{k}" for k in range(len(study.volume_gates))]
    out = df.select(*columns, *[F.col(c).alias(f"__e{k}") for k, c in enumerate(equal)], *[bucket(g).alias(f"__g{k}") for k, g in enumerate(study.volume_gates)])
    for k, g in enumerate(study.volume_gates):
        if spread and g.distance:
            out = out.withColumn(f"__g{k}", F.explode(F.sequence(F.col(f"__g{k}") - g.distance, F.col(f"__g{k}") + g.distance)))
    return out.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])), keys


def micropools(study: Study, tests: DataFrame, controls: DataFrame, propensity: str = "propensity_decile") -> DataFrame:
    """All (test, control) candidates: equal categorical gates [and propensity decile], merged deciles near enough.

    The pairs themselves, for whoever wants to see them; matching and pool sizes work without.
    """
    equal = [*study.gates, *([propensity] if study.propensity_gate else [])]
    used = sorted({p.column for p in study.points})
    named = lambda side: [F.col(study.subject).alias(f"{side}_{study.subject}"), *[F.col(c).alias(f"{side}_{c}") for c in used]]
    left, keys = _cells(study, tests, [*named("test"), *equal], True, propensity)
    right, _ = _cells(study, controls, named("control"), False, propensity)
    return left.join(right, keys).drop(*keys)


def pool_sizes(study: Study, tests: DataFrame, controls: DataFrame, propensity: str = "propensity_decile") -> DataFrame:
    """``(test, pool)``: candidates of each test that has any, from counts of controls by cell."""
    test = f"test_{study.subject}"
    left, keys = _cells(study, tests, [F.col(study.subject).alias(test)], True, propensity)
    right, _ = _cells(study, controls, [], False, propensity)
    return left.join(right.groupBy(*keys).agg(F.count("*").alias("__n")), keys).groupBy(test).agg(F.sum("__n").alias("pool"))


#: Distances this far apart count as equal, and the width of the cells by which values this near are found.
TIE, GRID = 1e-9, 1e-6


def _neighbours(rows: DataFrame, within: list[str]) -> DataFrame:
    """``rows`` (within, v, test; a control's row has no test) of tests, with the control values next to theirs: ``pred``, ``succ``.

    Range partitions in the order of the values, so a crowded cell lies in several tasks; values at the edges of
    partitions are carried on by a table of a row a task and cell.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.withColumn("cv", F.when(F.col("test").isNull(), F.col("v"))).repartitionByRange(n, *within, "v", "test").withColumn("part", F.spark_partition_id()))
    up, down = (Window.partitionBy("part", *within).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ([F.col("v"), F.col("test").asc_nulls_first()], [F.col("v").desc(), F.col("test").asc_nulls_first()]))
    edges = dealt.groupBy("part", *within).agg(F.min("cv").alias("lo"), F.max("cv").alias("hi"))
    before, after = (Window.partitionBy(*within).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("part"), F.col("part").desc()))
    edges = edges.select("part", *within, F.max("hi").over(before).alias("below"), F.min("lo").over(after).alias("above"))
    found = dealt.withColumns({"p": F.last("cv", ignorenulls=True).over(up), "s": F.last("cv", ignorenulls=True).over(down)}).where(F.col("test").isNotNull())
    return found.join(edges, ["part", *within]).select(*within, "v", "test", F.coalesce("p", "below").alias("pred"), F.coalesce("s", "above").alias("succ"))


#: Scored columns up to which controls are looked up by sets of columns: each control makes 2^k - 1 rows for that. With
#: more columns each control at the smallest distance makes a row for its test.
SETS = 6


def _by_sets(study: Study, keys: list[str], nearest: DataFrame, vectors: DataFrame) -> DataFrame:
    """(test, control, points): for each set of scored columns, the smallest control of a cell that is nearest in all of them.

    ``nearest`` has the nearest control values ``cv`` by test, cell and column ``k``. A control in the set that is nearest
    in other columns too comes up again by a larger set, so the most points of a test are exact, and the smallest id with it.
    """
    n = len(study.points)
    sets = [[k for k in range(n) if mask >> k & 1] for mask in range(1, 1 << n)]
    points = [sum(float(study.points[k].points) for k in members) for members in sets]
    at = [f"__v{k}" for k in range(n)]

    def row(which: int, chosen: dict[int, Column]) -> Column:
        return F.struct(F.lit(which).alias("__s"), *[chosen.get(k, F.lit(0.0)).alias(at[k]) for k in range(n)])

    def tries(which: int, rest: list[int], chosen: dict[int, Column]) -> Column:
        """Rows for all ways to take one nearest value of each column of a set; none if a column has no value."""
        if len(rest) == 1:
            return F.transform(f"__n{rest[0]}", lambda x: row(which, chosen | {rest[0]: x}))
        return F.flatten(F.transform(f"__n{rest[0]}", lambda x: tries(which, rest[1:], chosen | {rest[0]: x})))

    every = nearest.groupBy("test", *keys).agg(*[F.collect_set(F.when(F.col("k") == k, F.col("cv"))).alias(f"__n{k}") for k in range(n)])
    asked = every.select("test", *keys, F.explode(F.concat(*[tries(i, members, {}) for i, members in enumerate(sets)])).alias("x")).select("test", *keys, "x.*")
    known = [F.col("vs")[k]["v"].isNotNull() & ~F.isnan(F.col("vs")[k]["v"]) for k in range(n)]
    rows = [F.when(reduce(lambda a, b: a & b, [known[k] for k in members]), row(i, {k: F.col("vs")[k]["v"] for k in members})) for i, members in enumerate(sets)]
    having = vectors.select(*keys, "control", F.explode(F.array_compact(F.array(*rows))).alias("x")).select(*keys, "control", "x.*")
    having = having.groupBy(*keys, "__s", *at).agg(F.min("control").alias("control"))
    worth = F.element_at(F.array(*[F.lit(p) for p in points]), F.col("__s") + 1)
    return asked.join(having, [*keys, "__s", *at]).select("test", "control", worth.alias("points"))


def best_matches(study: Study, tests: DataFrame, controls: DataFrame, propensity: str = "propensity_decile") -> DataFrame:
    """``(test, control, points)``: for each test the control with most points, the smallest id on ties.

    For each scored column, the nearest control or controls (within 1e-9) of the test's pool earn its points. No pairs
    are formed: a test's values are placed among the control values of its cells, which gives those next to it, and the
    values at the smallest distance are looked up together with the smallest id of the controls that have them, so any
    number of tied controls is one row. A test whose pool earns no points takes the smallest id.
    """
    test, control = f"test_{study.subject}", f"control_{study.subject}"
    if any(p.points < 0 for p in study.points):
        raise ConfigError("points can't be negative")
    values = lambda: F.array(*[F.struct(F.lit(k).alias("k"), F.col(p.column).cast("double").alias("v")) for k, p in enumerate(study.points)])
    left, keys = _cells(study, tests, [F.col(study.subject).alias("test"), *([values().alias("vs")] if study.points else [])], True, propensity)
    right, _ = _cells(study, controls, [F.col(study.subject).alias("control"), *([values().alias("vs")] if study.points else [])], False, propensity)
    first = right.groupBy(*keys).agg(F.min("control").alias("control"))
    scored = left.join(first, keys).select("test", "control", F.lit(0.0).alias("points"))
    if study.points:
        within = [*keys, "k"]
        long = lambda df, who: df.select(*keys, *who, F.explode("vs").alias("x")).select(*keys, *who, "x.k", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
        left = cut(left)
        vectors = cut(right.groupBy(*keys, "vs").agg(F.min("control").alias("control")))
        held = long(vectors, ["control"])
        distinct = held.select(*within, "v").distinct()
        marks = long(left, ["test"])
        kind = marks.schema["test"].dataType
        placed = _neighbours(marks.select(*within, "v", "test").unionByName(distinct.withColumn("test", F.lit(None).cast(kind))), within)
        # least() skips nulls: a test with controls on one side only has that distance.
        gap = F.least(F.abs(F.col("v") - F.col("pred")), F.abs(F.col("succ") - F.col("v")))
        placed = cut(placed.withColumn("gap", gap).where(F.col("gap").isNotNull()))
        least = placed.groupBy("test", "k").agg(F.min("gap").alias("least"))
        near = placed.join(least, ["test", "k"]).where(F.col("gap") <= F.col("least") + TIE)
        edges = [F.floor((F.col("v") + sign * F.col("least") + shift) / GRID).cast("long") for sign in (-1, 1) for shift in (-TIE, TIE)]
        wanted = near.select(*within, "test", "v", "least", F.explode(F.array_distinct(F.array(*edges))).alias("cell"))
        hit = F.abs(F.abs(F.col("v") - F.col("cv")) - F.col("least")) <= TIE
        nearest = lambda df, who: wanted.join(df.select(*within, F.col("v").alias("cv"), *who, F.floor(F.col("v") / GRID).cast("long").alias("cell")), [*within, "cell"]).where(hit)
        if len(study.points) <= SETS:
            scored = scored.unionByName(_by_sets(study, keys, nearest(distinct, []), vectors))
        else:
            worth = F.element_at(F.array(*[F.lit(float(p.points)) for p in study.points]), F.col("k") + 1)
            pairs = nearest(held, ["control"]).groupBy("test", "control").agg(F.sum(worth).alias("points"))
            scored = scored.unionByName(pairs)
    best = scored.groupBy("test").agg(F.min(F.struct((-F.col("points")).alias("loss"), F.col("control"))).alias("b"))
    return best.select(F.col("test").alias(test), F.col("b.control").alias(control), (-F.col("b.loss")).alias("points"))


def eligible(study: Study, df: DataFrame) -> DataFrame:
    """Subjects with a positive value in any column that the study asks for."""
    if not study.eligible:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in study.eligible]))


def match_controls(study: Study, df: DataFrame, reached: str = "reached") -> tuple[DataFrame, DataFrame]:
    """(matches, pool sizes) of the eligible subjects."""
    ok = eligible(study, df)
    tests, controls = ok.where(F.col(reached) == 1), ok.where(F.col(reached) == 0)
    return best_matches(study, tests, controls), pool_sizes(study, tests, controls)


def autotuned(study: Study, df: DataFrame, reached: str = "reached") -> Study:
    """The study with its volume gates relaxed, one decile of one gate at a time in the order of the schedule, until
    the share of eligible tests with any candidate reaches the target or the schedule is through."""
    if not study.autotune or not study.autotune.steps:
        return study
    ok = cut(eligible(study, df))
    tests, controls = ok.where(F.col(reached) == 1), ok.where(F.col(reached) == 0)
    n = tests.count()

    def enough(s: Study) -> bool:
        return n == 0 or pool_sizes(s, tests, controls).count() / n >= study.autotune.target

    distance = {g.column: g.distance for g in study.volume_gates}
    current = study
    for step in study.autotune.steps:
        if step.column not in distance:
            raise ConfigError(f"autotune relaxes {step.column}, which is no volume gate")
        while distance[step.column] < step.distance:
            if enough(current):
                return current
            distance[step.column] += 1
            current = replace(study, volume_gates=tuple(VolumeGate(c, d) for c, d in distance.items()))
    return current


def match_counts(study: Study, tests: DataFrame, matches: DataFrame, sizes: DataFrame, decile: str) -> DataFrame:
    """By decile: tests tried, tests matched, and mean pool size."""
    key = f"test_{study.subject}"
    rows = tests.select(F.col(study.subject).alias(key), decile).join(sizes, key, "left").join(matches.select(key, F.lit(1).alias("hit")), key, "left")
    return rows.groupBy(decile).agg(F.count("*").alias("attempts"), F.count("hit").alias("matched"), F.coalesce(F.avg("pool"), F.lit(0.0)).alias("mean_pool"))


def pair_rows(study: Study, matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Both sides of each pair with their rows; a control used twice appears twice. ``treatment`` is 1 or 0."""
    test, control = f"test_{study.subject}", f"control_{study.subject}"
    sides = matches.select(F.explode(F.array(F.struct(F.col(test).alias("s"), F.lit(1).alias("t")), F.struct(F.col(control).alias("s"), F.lit(0).alias("t")))).alias("x"))
    return sides.select(F.col("x.s").alias(study.subject), F.col("x.t").alias("treatment")).join(rows, study.subject)


def placebo(pairs: DataFrame, columns: tuple[str, ...], largest: float) -> DataFrame:
    """For each column before treatment: group means, their gap, and whether it stays below ``largest``."""
    cells = pairs.select("treatment", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m"))
    on = lambda k: F.avg(F.when(F.col("treatment") == k, F.col("m.v")))
    out = cells.groupBy(F.col("m.measure").alias("measure")).agg(on(1).alias("test_mean"), on(0).alias("control_mean"))
    gap = F.abs(F.col("test_mean") - F.col("control_mean"))
    return out.select("measure", "test_mean", "control_mean", gap.alias("gap"), F.coalesce(gap <= largest, F.lit(False)).alias("passed"))
