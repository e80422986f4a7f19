"""One rule for every aggregate, with deterministic first and last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Aggregate


def aggregate(value: Column | str, how: Aggregate | str, order: Column | str | None = None, components: Column | str | None = None) -> Column:
    """Aggregate column. any = max, all = min; first and last go by ``order`` (a time, or a struct to break ties),
    most and least recent by ``components`` where given and else by ``order``; a linear trend falls back to the mean."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.col(order) if isinstance(order, str) else order
    level = F.col(components) if isinstance(components, str) else components
    how = Aggregate(how)
    seen = lambda o: F.when(v.isNotNull(), o)  # noqa: E731  nulls are no observations
    if how in (Aggregate.MAX, Aggregate.ANY):
        return F.max(v)
    if how in (Aggregate.MIN, Aggregate.ALL):
        return F.min(v)
    if how is Aggregate.SUM:
        return F.sum(v)
    if how is Aggregate.COUNT:
        return F.count(v)
    if how in (Aggregate.FIRST, Aggregate.LEAST_RECENT):
        by = level if how is Aggregate.LEAST_RECENT and level is not None else at
        return F.min_by(v, seen(by)) if by is not None else F.min(v)
    if how in (Aggregate.LAST, Aggregate.MOST_RECENT):
        by = level if how is Aggregate.MOST_RECENT and level is not None else at
        return F.max_by(v, seen(by)) if by is not None else F.max(v)
    return F.avg(v)
