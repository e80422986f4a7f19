"""Signal policies over streams: event-time windows with a watermark as the TTL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..model import Aggregate


def tumbling_stream(df: DataFrame, time: str, value: str, keys: Sequence[str], duration_ms: int, ttl_ms: int, how: Aggregate | str = Aggregate.MEAN, min_samples: int = 1) -> DataFrame:
    """Tumbling policy on a stream or table; rows later than ``ttl_ms`` behind the newest are dropped on a stream."""
    late = df.withWatermark(time, f"{ttl_ms} milliseconds")
    cells = late.groupBy(*keys, F.window(time, f"{duration_ms} milliseconds").alias("w"))
    out = F.when(F.count(value) >= min_samples, aggregate(value, how, time))
    return cells.agg(out.alias(value), F.count(value).alias("n")).select(*keys, F.col("w.start").alias(time), value, "n")


def deduplicated_stream(df: DataFrame, time: str, keys: Sequence[str], ttl_ms: int) -> DataFrame:
    """First row of each key within the watermark."""
    return df.withWatermark(time, f"{ttl_ms} milliseconds").dropDuplicatesWithinWatermark(list(keys))
