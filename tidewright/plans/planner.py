"""Decisions that need no data: grid rates, joins, resampling paths, how sources compose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..errors import RequestError
from ..model import Measurement, ReportInterval


@dataclass(frozen=True)
class Alignment:
    """The grid rate that all units share, and what each unit needs to get there."""

    rate_ms: int
    actions: dict[str, str]


def align(units: Sequence[Measurement]) -> Alignment | None:
    """The common rate; else the fastest if every slower unit may be upsampled; else the slowest."""
    rates = {m.name: m.sample_rate_ms for m in units if m.sample_rate_ms}
    if not rates:
        return None
    fastest, slowest = min(rates.values()), max(rates.values())
    rate = fastest if all(m.upsample or m.sample_rate_ms == fastest for m in units if m.sample_rate_ms) else slowest
    actions = {}
    for m in units:
        if not m.sample_rate_ms:
            actions[m.name] = "pass_through"
        elif m.sample_rate_ms == rate:
            actions[m.name] = "signal_only"
        else:
            actions[m.name] = "upsample" if m.sample_rate_ms > rate else "downsample"
    return Alignment(rate, actions)


def grid_interval(units: Sequence[Measurement], aligned: Alignment | None, requested_ms: int | None) -> int:
    """An aligned universe's rate, else the request's interval, else the longest TTL."""
    if aligned:
        return aligned.rate_ms
    if requested_ms:
        return requested_ms
    ttls = [m.policy.ttl for m in units if m.policy]
    if not ttls:
        raise RequestError("no interval was asked for, and no unit has a TTL")
    return max(ttls)


def join_kind(unit: Measurement, interval_ms: int) -> str:
    """Equal grids join on equal times; any other grid joins as of, within the TTL."""
    return "equi" if unit.sample_rate_ms == interval_ms else "asof"


def join_groups(units: Sequence[Measurement], source_of: dict[str, str]) -> list[list[Measurement]]:
    """Units that share source, components, policy and rate are planned as one wide frame."""
    groups: dict[tuple, list[Measurement]] = {}
    for m in units:
        kind = m.policy.kind if m.policy else None
        key = (source_of.get(m.name, m.name), m.components, m.policy, m.sample_rate_ms, m.temporality, kind == "instant" or m.name)
        groups.setdefault(key, []).append(m)
    return list(groups.values())


def resample_path(rate_ms: int, report: ReportInterval, upsample: bool) -> str:
    """passthrough, aggregate, upsample or sparse, from a unit's rate and the bucket's size."""
    bucket = report.approximate_ms
    if rate_ms == bucket:
        return "passthrough"
    if rate_ms < bucket:
        return "aggregate"
    if report.strategy == "sparse" or (report.strategy == "auto" and not upsample):
        return "sparse"
    if not upsample:
        raise RequestError("the unit's rate is coarser than the bucket and it declares no upsampling")
    return "upsample"


def composition(a: tuple[str, str | None, tuple[str, ...]], b: tuple[str, str | None, tuple[str, ...]]) -> str:
    """How two domains (subject, time, components) go together: stack, reduce, join, or incompatible."""
    if a[0] != b[0]:
        return "incompatible"
    if a == (b[0], b[1], b[2]) or (a[1] == b[1] and sorted(a[2]) == sorted(b[2])):
        return "stack"
    if a[1] == b[1] and (set(a[2]) < set(b[2]) or set(b[2]) < set(a[2])):
        return "reduce"
    return "join"
