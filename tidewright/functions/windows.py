"""Analytic functions along time, across subjects, and over subject-level scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..model import OverSubjects, OverTime
from ..operators.materialize import cut
from .calendar import micros

#: Microseconds in a unit of time.
UNIT_MICROS = {"us": 1, "ms": 1000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "day": 86_400_000_000}


def over_time(spec: OverTime, subject: str, time: str) -> Column:
    """Along each subject's rows in time order. Null inputs stay null in a running sum."""
    v, w = F.col(f"`{spec.input}`"), Window.partitionBy(subject).orderBy(time)
    rows = w.rowsBetween(-(spec.n - 1), 0)
    if spec.op == "derivative":
        elapsed = (micros(time) - F.lag(micros(time)).over(w)) / UNIT_MICROS[spec.unit]
        return F.try_divide((v - F.lag(v).over(w)).cast("double"), elapsed)
    if spec.op == "rolling_mean":
        return F.avg(v).over(rows)
    if spec.op == "rolling_sum":
        return F.sum(v).over(rows)
    if spec.op == "lag":
        return F.lag(v, spec.n).over(w)
    if spec.op == "lead":
        return F.lead(v, spec.n).over(w)
    if spec.op == "cum_sum":
        return F.when(v.isNotNull(), F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if spec.op == "diff":
        return v - F.lag(v, spec.n).over(w)
    raise RequestError(f"unknown derivation along time: {spec.op}")


def bucket_of(spec: OverSubjects) -> Column:
    """The first break that a value does not exceed; beyond all of them, and for nulls, the number of breaks."""
    v = F.col(f"`{spec.input}`")
    if not spec.breaks:
        return F.lit(0)
    out = F.when(v <= spec.breaks[0], F.lit(0))
    for i, b in enumerate(spec.breaks[1:], 1):
        out = out.when(v <= b, F.lit(i))
    return out.otherwise(F.lit(len(spec.breaks)))


def over_subjects(df: DataFrame, spec: OverSubjects, subject: str, time: str, out: str) -> DataFrame:
    """``df`` with ``out``, a function across the subjects of each time.

    No task gets all subjects of a time: sums and deviations are partial aggregates joined back by time, ranks are
    local ranks in range partitions by (time, value) with the counts of the partitions before added.
    """
    v = F.col(f"`{spec.input}`")
    if spec.op == "bucket":
        return df.withColumn(out, bucket_of(spec))
    names = [F.col(f"`{c}`") for c in df.columns]
    if spec.op in ("percent_of", "z_score", "deviation"):
        df = cut(df)  # read twice
        stats = df.groupBy(F.col(time).alias("__time")).agg(F.sum(v).alias("__sum"), F.avg(v).alias("__mean"), F.stddev_samp(v).alias("__sd"))
        joined = df.join(stats, F.col(time).eqNullSafe(F.col("__time")), "left")
        made = {
            "percent_of": lambda: F.try_divide(v.cast("double") * 100, F.col("__sum")),
            "z_score": lambda: F.try_divide(v - F.col("__mean"), F.nullif("__sd", F.lit(0.0))),
            "deviation": lambda: v - F.col("__mean"),
        }
        return joined.select(*names, made[spec.op]().alias(out))
    if spec.op == "rank":
        order = v.desc_nulls_last() if spec.descending else v.asc_nulls_last()
        ran = running(df, [F.col(time), order, F.col(subject)], {"__rank": F.lit(1)}, [time])
        return ran.select(*names, F.when(v.isNotNull(), F.col("__rank").cast("int")).alias(out))
    if spec.op == "quantile":
        df = cut(df)  # read twice
        tied = df.where(v.isNotNull()).groupBy(F.col(time).alias("__time"), v.alias("__v")).agg(F.count("*").alias("__n"))
        ran = running(tied, ["__time", "__v"], {"__cum": F.col("__n")}, ["__time"])
        mean_rank = F.col("__cum") - F.col("__n") + 1 + (F.col("__n") - 1) / 2
        cut_at = ran.select("__time", "__v", F.ceil(mean_rank / F.col("__cum__all") * spec.n).cast("int").alias("__q"))
        joined = df.join(cut_at, (F.col(time).eqNullSafe(F.col("__time"))) & (v == F.col("__v")), "left")
        return joined.select(*names, F.col("__q").alias(out))
    raise RequestError(f"unknown derivation across subjects: {spec.op}")


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with running totals over one total order, as if by a window without partitions.

    Rows are range-partitioned by the order, summed up locally, and moved up by the totals of the partitions
    before. ``sums`` maps a new column to what it adds up; ``<name>__all`` is the grand total. The order must
    be total (end it with a unique key). ``within`` names columns that the order begins with: sums then begin anew
    for each of their values, and a value with very many rows still lies in several partitions.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumns({f"__x_{k}": c for k, c in sums.items()})
    # The partition's number is fixed with the rows, so both uses below must see the same split.
    dealt = keyed.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    dealt = cut(dealt)
    totals = dealt.groupBy("__part", *within).agg(*[F.sum(f"__x_{k}").alias(f"__t_{k}") for k in sums])  # a row a task, and one more a value
    group = list(within) or [F.lit(0)]
    ahead = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__w_{c}") for c in within], *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__o_{k}") for k in sums], *[F.sum(f"__t_{k}").over(Window.partitionBy(*group)).alias(f"{k}__all") for k in sums])
    local = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"__s_{k}": F.sum(f"__x_{k}").over(local) for k in sums})
    same = F.col("__part") == F.col("__p")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    out = summed.join(offsets if within else F.broadcast(offsets), same)  # without groups: one row a task
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__s_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums], *[f"{k}__all" for k in sums])


def equal_volume_deciles(df: DataFrame, columns: dict[str, str], subject: str, bins: int = 10) -> DataFrame:
    """``df`` with ``columns[value]`` for each value: bins of equal total value in (value, subject) order.

    0 for values of zero or less, and for nulls. All columns are ranked together in long form, in one pass over one
    range partitioning, whatever their number.
    """
    df = cut(df)
    cells = F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("double").alias("v")) for v in columns])
    long = df.select(F.col(subject).alias("__subject"), F.explode(cells).alias("c")).select("__subject", F.col("c.name").alias("__name"), F.col("c.v").alias("__v")).where("__v > 0")
    ran = running(long, ["__name", "__v", "__subject"], {"__cum": F.col("__v")}, ["__name"])
    part = F.floor((F.col("__cum") - 1e-9) / (F.col("__cum__all") / bins)) + 1
    placed = ran.select("__subject", "__name", F.greatest(F.least(part, F.lit(bins)), F.lit(1)).cast("long").alias("__d"))
    wide = placed.groupBy("__subject").agg(*[F.max(F.when(F.col("__name") == v, F.col("__d"))).alias(out) for v, out in columns.items()])
    zero = [F.coalesce(F.col(out), F.lit(0).cast("long")).alias(out) for out in columns.values()]
    return df.join(wide, F.col(subject) == F.col("__subject"), "left").select(*[F.col(f"`{c}`") for c in df.columns], *zero)


def equal_volume_decile(df: DataFrame, value: str, subject: str, out: str, bins: int = 10) -> DataFrame:
    """``equal_volume_deciles`` of one column."""
    return equal_volume_deciles(df, {value: out}, subject, bins)


def equal_count_bin(df: DataFrame, value: str, subject: str, out: str, bins: int = 10) -> DataFrame:
    """floor(rank / n * bins) + 1 in (value, subject) order, ranks from 0."""
    ran = running(df, [F.col(value), F.col(subject)], {"__rank": F.lit(1)})
    part = F.floor((F.col("__rank") - 1) / F.col("__rank__all") * bins) + 1
    return ran.select(*[F.col(f"`{c}`") for c in df.columns], part.cast("long").alias(out))


def equal_range_bin(value: Column | str, count: int) -> Column:
    """Bin of a score in (0, 1): 0 at zero or less, ``count`` at one or more."""
    v = F.col(value) if isinstance(value, str) else value
    inside = F.greatest(F.least(F.ceil(v * count), F.lit(count)), F.lit(1))
    return F.when(v <= 0, 0).when(v >= 1, count).otherwise(inside).cast("long")


def quantile_bin(df: DataFrame, value: str, subject: str, out: str, count: int) -> DataFrame:
    """Bins of equal count over positive scores; others are in bin 0."""
    ran = running(df, [F.col(value), F.col(subject)], {"__rank": (F.col(value) > 0).cast("int")})
    part = F.least(F.floor((F.col("__rank") - 1) * count / F.col("__rank__all")) + 1, F.lit(count))
    return ran.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(value) > 0, part).otherwise(0).cast("long").alias(out))


def auc(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """One row ``auc``: area under the curve of (false, true positives) in falling score, ties by ``tie``.

    Null where one of the classes is missing.
    """
    one = (F.col(label) == 1).cast("long")
    ran = running(df.select(score, label, tie), [F.col(score).desc(), F.col(tie)], {"__tp": one})
    n = F.count("*")
    negatives = n - F.sum(one)
    area = F.sum(F.when(one == 0, F.col("__tp")).otherwise(0)).cast("double")
    return ran.agg(F.try_divide(area, F.sum(one).cast("double") * negatives).alias("auc"))


def histogram_bin(value: Column | str, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the top edge is in the last bin, and a range of no width is bin 0."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.least(F.floor(F.try_divide((v - low) * bins, high - low)), F.lit(bins - 1)), F.lit(0)).cast("long")
