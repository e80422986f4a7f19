"""Time grids and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError


def micros(t: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone (read as UTC wall time), or of milliseconds."""
    c = F.col(t) if isinstance(t, str) else t
    return F.unix_micros(c.cast("timestamp"))


def from_micros(m: Column) -> Column:
    return F.timestamp_micros(m).cast("timestamp_ntz")


def floor_to(t: Column | str, step_ms: int) -> Column:
    """Start of the cell of an epoch-aligned grid, rounding down before 1970 too."""
    m, step = micros(t), step_ms * 1000
    return from_micros(m - F.pmod(m, F.lit(step)))


def bucket_start(t: Column | str, unit: str, count: int = 1) -> Column:
    """Start of a calendar bucket: months (from year 0), weeks from Monday, days, hours, or fixed milliseconds."""
    c = F.col(t) if isinstance(t, str) else t
    if unit == "months":
        index = F.year(c) * 12 + F.month(c) - 1
        start = index - F.pmod(index, F.lit(count))
        return F.make_timestamp_ntz(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if unit == "weeks":  # 1970-01-05 is a Monday
        m, step, shift = micros(c), 7 * 86_400_000_000 * count, 4 * 86_400_000_000
        return from_micros(m - F.pmod(m - shift, F.lit(step)))
    width = {"days": 86_400_000, "hours": 3_600_000, "fixed": 1}
    if unit not in width:
        raise RequestError(f"unknown bucket: {unit}")
    return floor_to(c, width[unit] * count)


def month_index(t: Column | str, first_year: int, first_month: int = 1) -> Column:
    """Months since the first one, which is 1."""
    c = F.col(t) if isinstance(t, str) else t
    return ((F.year(c) - first_year) * 12 + F.month(c) - first_month + 1).cast("long")


def index_to_month(index: Column | str, first_year: int, first_month: int = 1) -> Column:
    """YYYY-MM of a month index."""
    i = F.col(index) if isinstance(index, str) else index
    zero = (i - 1 + first_year * 12 + first_month - 1).cast("int")
    return F.format_string("%04d-%02d", F.floor(zero / 12).cast("int"), (F.pmod(zero, F.lit(12)) + 1).cast("int"))


def parse_month(text: str) -> tuple[int, int]:
    """(year, month) of YYYY-MM or YYYY-MM-DD."""
    try:
        year, month = int(text[:4]), int(text[5:7])
    except ValueError as e:
        raise RequestError(f"not a month: {text!r}") from e
    if not 1 <= month <= 12:
        raise RequestError(f"not a month: {text!r}")
    return year, month


def months_between(a: tuple[int, int], b: tuple[int, int]) -> int:
    return (b[0] - a[0]) * 12 + b[1] - a[1]


def time_extent(df: DataFrame, time: str) -> DataFrame:
    """One row: first and last time, and the span in milliseconds."""
    span = F.floor((micros(F.max(time)) - micros(F.min(time))) / 1000).cast("long")
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), span.alias("span_ms"))
