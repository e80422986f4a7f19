"""From irregular observations to a dense grid: signal policies, carry, resampling, as-of joins, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.aggregates import aggregate
from ..functions.calendar import bucket_start, floor_to, from_micros, micros
from ..functions.windows import running
from ..model import Aggregate, Downsample, Kind, ReportInterval, Upsample


#: Grid points that one array holds at most; longer stretches are exploded in two steps.
CHUNK = 4096


def explode_cells(df: DataFrame, low: str, high: str, step_ms: int, time: str) -> DataFrame:
    """``df`` times the grid points from floor(low) to high; no row where these are null or out of order.

    Columns ``low`` and ``high`` go, ``time`` comes. No array is longer than ``CHUNK`` points or chunks. Rows are dealt
    out before they grow: a few small ones would otherwise share a task, which then holds the whole grid.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step, wide = step_ms * 1000, step_ms * 1000 * CHUNK
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (low, high)]
    first = micros(low) - F.pmod(micros(low), F.lit(step))
    spans = df.select(*kept, first.alias("__lo"), micros(high).alias("__hi"))
    chunks = spans.withColumn("__c", F.explode(F.when(F.col("__lo") <= F.col("__hi"), F.sequence("__lo", "__hi", F.lit(wide))))).repartition(n, *kept, "__c")
    points = chunks.select(*kept, F.explode(F.sequence("__c", F.least(F.col("__c") + (wide - step), F.col("__hi")), F.lit(step))).alias("__m"))
    return points.select(*kept, from_micros(F.col("__m")).alias(time))


def grid_points(bounds: DataFrame, time: str, step_ms: int) -> DataFrame:
    """Every grid time from floor(low) to high of a one-row frame (low, high); no row where they are null."""
    return explode_cells(bounds.select("low", "high"), "low", "high", step_ms, time)


def dense(df: DataFrame, time: str, keys: Sequence[str], step_ms: int, bounds: DataFrame | None = None) -> DataFrame:
    """``df`` (one row for each key and grid time at most) with a row for each key at every grid time.

    The grid spans the times of all keys, or ``bounds`` (one row: low, high). Keys get their grid by exploding
    the time points of the one bounds row, so the row count is keys x cells and nothing else is crossed.
    """
    span = bounds if bounds is not None else df.agg(F.min(time).alias("low"), F.max(time).alias("high"))
    spans = df.select(*keys).distinct().join(F.broadcast(span.select(F.col("low").alias("__low"), F.col("high").alias("__high"))))  # one row
    return explode_cells(spans, "__low", "__high", step_ms, time).join(df, [*keys, time], "left")


def carry(value: str, time: str, keys: Sequence[str], cells: int) -> Column:
    """Last value no more than ``cells`` grid cells back, on a dense grid."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-max(0, cells), 0)
    return F.last(value, ignorenulls=True).over(w)


def carry_cells(ttl_ms: int, rate_ms: int) -> int:
    """Cells that a value is carried on: it holds for [t, t + ttl)."""
    return max(0, (ttl_ms - 1) // rate_ms)


def instant_cells(df: DataFrame, time: str, values: dict[str, Aggregate | str], keys: Sequence[str], rate_ms: int, ordered: bool = False) -> DataFrame:
    """One row for each key and grid cell with observations: an aggregate for each value, and the first and last
    observed time (``__low``, ``__high``). All columns of ``values`` share one scan and one shuffle.

    ``ordered`` adds up a cell's values in the order of their times, so the last bits of a mean don't depend on how the
    rows were split; rows, not partial sums, are shuffled for that.
    """
    floored = df.select(*keys, F.col(time).alias("__at"), floor_to(time, rate_ms).alias(time), *values)
    if ordered:
        floored = floored.repartition(*keys, time).sortWithinPartitions(*keys, time, "__at", *values)
    made = [aggregate(v, how, "__at").alias(v) for v, how in values.items()]
    return floored.groupBy(*keys, time).agg(*made, F.min("__at").alias("__low"), F.max("__at").alias("__high"))


def instant_of_cells(cells: DataFrame, time: str, values: Sequence[str], keys: Sequence[str], rate_ms: int, ttl_ms: int = 0, bounds: DataFrame | None = None) -> DataFrame:
    """Cells on a dense grid, each value carried within the TTL; ``ttl_ms`` 0 carries nothing."""
    full = dense(cells.select(*keys, time, *values), time, keys, rate_ms, bounds)
    n = carry_cells(ttl_ms, rate_ms) if ttl_ms else 0
    return full.select(*keys, time, *[(carry(v, time, keys, n) if n else F.col(v)).alias(v) for v in values])


def instant(df: DataFrame, time: str, values: dict[str, Aggregate | str], keys: Sequence[str], rate_ms: int, ttl_ms: int = 0, bounds: DataFrame | None = None) -> DataFrame:
    """Instant policy: grid cells of ``rate_ms``, one aggregate for each value, then carried within the TTL."""
    return instant_of_cells(instant_cells(df, time, values, keys, rate_ms), time, list(values), keys, rate_ms, ttl_ms, bounds)


def instant_aggregate(kind: Kind, how: Aggregate = Aggregate.AUTO, text: bool = False) -> Aggregate:
    """Within a grid cell: max for flags, the last of text categories, an explicit choice, else the mean."""
    if how is not Aggregate.AUTO:
        return how
    if kind is Kind.BINARY:
        return Aggregate.MAX
    return Aggregate.LAST if text else Aggregate.MEAN


def sliding(df: DataFrame, time: str, value: str, keys: Sequence[str], duration_ms: int, how: Aggregate | str = Aggregate.MEAN, min_samples: int = 1, legacy_rows: bool = False) -> DataFrame:
    """Sliding policy: each row's aggregate over the ``duration_ms`` before it, itself included, (t - d, t].

    Null where the window has fewer than ``min_samples`` values. last is the row's own value, first the one
    before it. ``legacy_rows`` takes all rows so far instead of a stretch of time.
    """
    w = Window.partitionBy(*keys).orderBy(micros(time))
    span = w.rowsBetween(Window.unboundedPreceding, 0) if legacy_rows else w.rangeBetween(-(duration_ms * 1000 - 1), 0)
    how = Aggregate(how)
    if how is Aggregate.LAST:
        out = F.col(value)
    elif how is Aggregate.FIRST:
        out = F.lag(value).over(w)
    else:
        out = aggregate(value, how).over(span)
    return df.withColumn(value, F.when(F.count(value).over(span) >= min_samples, out))


def tumbling(df: DataFrame, time: str, value: str, keys: Sequence[str], duration_ms: int, how: Aggregate | str = Aggregate.MEAN, min_samples: int = 1, others: Sequence[str] = ()) -> DataFrame:
    """Tumbling policy: epoch-aligned buckets; null below ``min_samples``; other columns keep their first value."""
    cells = df.select(*keys, F.col(time).alias("__at"), floor_to(time, duration_ms).alias(time), value, *others).groupBy(*keys, time)
    out = F.when(F.count(value) >= min_samples, aggregate(value, how, "__at"))
    return cells.agg(out.alias(value), *[aggregate(o, Aggregate.FIRST, "__at").alias(o) for o in others])


def resample(df: DataFrame, time: str, value: str, keys: Sequence[str], rate_ms: int, strategy: Upsample | Downsample | str) -> DataFrame:
    """Up: a finer grid over each key's own span, filled forward, linearly, or not. Down: one aggregate a cell."""
    return resample_wide(df, time, {value: strategy}, keys, rate_ms)


def resample_wide(df: DataFrame, time: str, values: dict[str, Upsample | Downsample | str], keys: Sequence[str], rate_ms: int) -> DataFrame:
    """All columns of ``values`` in one pass, each by its own strategy; all go up or all go down."""
    text = {v: str(getattr(how, "value", how)) for v, how in values.items()}
    down = [v for v, how in text.items() if how in [d.value for d in Downsample]]
    if down and len(down) < len(values):
        raise RequestError("columns of one frame can't go both up and down")
    if down:
        cells = df.select(*keys, F.col(time).alias("__at"), floor_to(time, rate_ms).alias(time), *values).groupBy(*keys, time)
        return cells.agg(*[aggregate(v, Aggregate(how), "__at").alias(v) for v, how in text.items()])
    step = rate_ms * 1000
    spans = df.groupBy(*keys).agg(F.min(time).alias("__low"), F.max(time).alias("__high"))
    both = explode_cells(spans, "__low", "__high", rate_ms, time).join(df.select(*keys, time, *values), [*keys, time], "full")
    w = Window.partitionBy(*keys).orderBy(time)
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def filled(value: str, how: Upsample) -> Column:
        if how is Upsample.NULL:
            return F.col(value)
        known = F.when(F.col(value).isNotNull(), F.struct(micros(time).alias("m"), F.col(value).alias("v")))
        before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if how is Upsample.FORWARD_FILL:
            return before["v"]
        after = F.last(known, ignorenulls=True).over(back)  # the next one: a frame that looks ahead is read again for each row
        slope = (after["v"] - before["v"]) * (micros(time) - before["m"]) / (after["m"] - before["m"])
        return F.when(before["m"] == after["m"], before["v"].cast("double")).otherwise(before["v"] + slope)

    made = both.select(*keys, time, *[filled(v, Upsample(how)).alias(v) for v, how in text.items()])
    return made.where(F.pmod(micros(time), F.lit(step)) == 0)


def asof(left: DataFrame, right: DataFrame, time: str, keys: Sequence[str], values: Sequence[str], tolerance_ms: int | None = None, right_time: str | None = None) -> DataFrame:
    """Backward as-of join: each left row with the right row of its keys at the same time or last before it.

    One shuffle: both sides in one frame, sorted by time with right rows first, and the last right row carried
    along. Older than ``tolerance_ms``: null. ``right_time`` names a column for the matched time. Of right rows
    at one time the largest by value wins.
    """
    place = lambda df, side, kept: df.select(*keys, F.col(time).alias("__t"), F.lit(side).alias("__side"), *kept)
    own = [c for c in left.columns if c not in (*keys, time)]
    none = lambda df, names: [F.lit(None).cast(df.schema[n].dataType).alias(f"__l_{n}") for n in names]
    packed = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in values]).alias("__r")
    empty = F.lit(None).cast(right.select(packed).schema[0].dataType).alias("__r")
    rows = place(left, 1, [*[F.col(c).alias(f"__l_{c}") for c in own], empty]).unionByName(place(right, 0, [*none(left, own), packed]))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    fresh = F.lit(True) if tolerance_ms is None else micros("__t") - micros(F.col("__m")["t"]) <= tolerance_ms * 1000
    out = [F.when(fresh, F.col("__m")[v]).alias(v) for v in values]
    if right_time:
        out.append(F.when(fresh, F.col("__m")["t"]).alias(right_time))
    return found.select(*keys, F.col("__t").alias(time), *[F.col(f"__l_{c}").alias(c) for c in own], *out)


def estimate_rate(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """One row ``rate_ms``: exact median of the positive gaps between a key's successive times.

    Gaps are counted by value and ranked with distributed running sums, so no task holds them all.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = df.select((micros(time) - F.lag(micros(time)).over(w)).alias("gap")).where("gap > 0").groupBy("gap").agg(F.count("*").alias("n"))
    ran = running(gaps, ["gap"], {"__cum": F.col("n")})
    low = F.min(F.when(F.col("__cum") >= F.floor((F.col("__cum__all") + 1) / 2), F.col("gap")))
    high = F.min(F.when(F.col("__cum") >= F.floor(F.col("__cum__all") / 2) + 1, F.col("gap")))
    return ran.agg(F.round((low + high) / 2000).cast("long").alias("rate_ms"))


def report(df: DataFrame, interval: ReportInterval, subject: str, time: str, values: dict[str, Aggregate | str], configured: dict | None = None) -> DataFrame:
    """Calendar buckets: for each subject and bucket the aggregate of each value, and n, null_count, std, min, max, stderr.

    Overrides replace a value's aggregate. Where the interval says what an empty bucket holds (``empty``, or
    ``empty_from_config`` with the values' own literals in ``configured``), every bucket between a subject's first and
    last row is returned, also without rows; otherwise those that have rows.
    """
    cells = df.withColumn("__bucket", bucket_start(time, interval.unit, interval.count)).groupBy(subject, F.col("__bucket").alias("bucket"))
    out: list[Column] = []
    for v, default in values.items():
        out.append(aggregate(v, interval.overrides.get(v, default), time).alias(v))
        if interval.stats:
            n = F.count(v)
            out += [n.alias(f"{v}_n"), F.count_if(F.col(v).isNull()).alias(f"{v}_null_count"), F.stddev_samp(v).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.try_divide(F.stddev_samp(v), F.sqrt(n)).alias(f"{v}_stderr")]
    made = cells.agg(*out).withColumnRenamed("bucket", time)
    if interval.empty is None and not interval.empty_from_config:
        return made
    spans = df.groupBy(subject).agg(bucket_start(F.min(time), interval.unit, interval.count).alias("__low"), bucket_start(F.max(time), interval.unit, interval.count).alias("__high"))
    step = F.expr(f"INTERVAL {interval.count} MONTH") if interval.unit == "months" else F.expr(f"INTERVAL {interval.approximate_ms // 1000} SECOND")
    if interval.unit == "fixed":
        step = F.expr(f"make_dt_interval(0, 0, 0, {interval.approximate_ms / 1000})")
    buckets = spans.select(subject, F.explode(F.sequence("__low", "__high", step)).alias(time))
    full = buckets.join(made, [subject, time], "left")
    fills = {v: (configured or {}).get(v) if interval.empty_from_config else interval.empty for v in values}
    full = full.withColumns({v: F.coalesce(F.col(v), F.lit(x)) for v, x in fills.items() if x is not None})
    if interval.stats:
        full = full.withColumns({f"{v}_{k}": F.coalesce(F.col(f"{v}_{k}"), F.lit(0)) for v in values for k in ("n", "null_count")})
    return full.select(*made.columns)


def policy_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """One row: rows, filled rows, fill rate and number of keys of an aligned frame."""
    n = F.count("*")
    return df.agg(n.alias("n_rows"), F.count(value).alias("n_filled"), F.try_divide(F.count(value), n).alias("fill_rate"), F.count_distinct(*keys).alias("n_keys"))


def check_aligned(df: DataFrame, time: str, keys: Sequence[str], rate_ms: int) -> None:
    """Raise unless the frame is on the grid, has one row for each key and time, and the same cells for every key."""
    cells = df.select(F.pmod(micros(time), F.lit(rate_ms * 1000)).alias("o"), *keys, time).groupBy(*keys, time).agg(F.max("o").alias("o"), F.count("*").alias("n"))
    spans = cells.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"), F.count("*").alias("cells"), ((micros(F.max(time)) - micros(F.min(time))) / (rate_ms * 1000) + 1).alias("span"))
    off, twice, least, most, gaps = spans.agg(F.max("o"), F.max("n"), F.min("cells"), F.max("cells"), F.count_if(F.col("cells") != F.col("span"))).first()
    if (off or 0) > 0 or (twice or 1) > 1:
        raise RequestError("the frame is off its grid, or has two rows for a cell")
    if least != most or gaps:
        raise RequestError("keys have different cells, or a grid has gaps")


def check_policy(raw: DataFrame, aligned: DataFrame, time: str, value: str, keys: Sequence[str], rate_ms: int, ttl_ms: int) -> None:
    """Raise unless ``aligned`` is a dense grid, keeps the value's type, and has a value exactly where the TTL allows one."""
    kinds = raw.schema[value].dataType.typeName(), aligned.schema[value].dataType.typeName()
    if "string" in kinds and kinds[0] != kinds[1]:
        raise RequestError(f"{value} was {kinds[0]} and became {kinds[1]}")
    check_aligned(aligned, time, keys, rate_ms)
    seen = raw.where(F.col(value).isNotNull()).select(*keys, floor_to(time, rate_ms).alias(time), F.lit(1).alias("__seen")).distinct()
    held = asof(aligned, seen, time, keys, ["__seen"], carry_cells(ttl_ms, rate_ms) * rate_ms)
    if not held.where(F.col("__seen").isNotNull() != F.col(value).isNotNull()).isEmpty():
        raise RequestError(f"{value} is missing within its TTL, or is there beyond it")
