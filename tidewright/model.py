"""Declared model: schemas, measurements, derivations, policies and requests. Pure Python, no Spark."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from .errors import RequestError, SchemaError


class Aggregate(str, Enum):
    MEAN, SUM, MIN, MAX = "mean", "sum", "min", "max"
    ANY, ALL, COUNT = "any", "all", "count"
    FIRST, LAST = "first", "last"
    MOST_RECENT, LEAST_RECENT = "most_recent", "least_recent"
    LINEAR_TREND, AUTO = "linear_trend", "auto"


class Kind(str, Enum):
    """What a measurement means, which sets how it is aggregated by default."""

    COUNT, MEASURE, AVERAGE, CATEGORICAL, BINARY = "count", "measure", "average", "categorical", "binary"

    @property
    def default_aggregate(self) -> Aggregate:
        by = {Kind.COUNT: Aggregate.SUM, Kind.CATEGORICAL: Aggregate.LAST, Kind.BINARY: Aggregate.ANY}
        return by.get(self, Aggregate.MEAN)


class Temporality(str, Enum):
    """Historical data ends at the clock; forecasts keep their own range."""

    HISTORICAL, FORECAST = "historical", "forecast"


class Upsample(str, Enum):
    FORWARD_FILL, INTERPOLATE, NULL = "forward_fill", "interpolate", "null"


class Downsample(str, Enum):
    MEAN, MAX, MIN, SUM, LAST = "mean", "max", "min", "sum", "last"


_UNITS_MS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str | int | float) -> int:
    """Milliseconds of a duration such as "90s", "1h 30m" or a number of seconds; must be positive."""
    if isinstance(text, (int, float)):
        total = int(text * 1000)
    else:
        parts = re.findall(r"(\d+)\s*(ms|min|[smhdw])[a-z]*\s*", text)
        if not parts or "".join(re.findall(r"[^\s]", text)) == "":
            raise RequestError(f"not a duration: {text!r}")
        total = sum(int(n) * _UNITS_MS[u] for n, u in parts)
    if total <= 0:
        raise RequestError(f"a duration must be positive: {text!r}")
    return total


@dataclass(frozen=True)
class SignalPolicy:
    """How raw observations become a signal. ttl and duration in milliseconds."""

    kind: str = "instant"
    ttl: int = 60_000
    duration: int = 0
    min_samples: int = 1
    time_format: str | None = None

    @classmethod
    def instant(cls, ttl: str | int = 60, time_format: str | None = None) -> SignalPolicy:
        return cls("instant", duration_ms(ttl), time_format=time_format)

    @classmethod
    def sliding(cls, duration: str | int, min_samples: int = 1, ttl: str | int = 60) -> SignalPolicy:
        return cls("sliding", duration_ms(ttl), duration_ms(duration), min_samples)

    @classmethod
    def tumbling(cls, duration: str | int, min_samples: int = 1, ttl: str | int = 60) -> SignalPolicy:
        return cls("tumbling", duration_ms(ttl), duration_ms(duration), min_samples)

    @classmethod
    def from_json(cls, text: str | dict) -> SignalPolicy:
        d = json.loads(text) if isinstance(text, str) else dict(text)
        windowing = d.get("windowing", "instant")
        kind, spec = (windowing, {}) if isinstance(windowing, str) else next(iter(windowing.items()))
        ttl = duration_ms(d.get("max_staleness", d.get("ttl", 60)))
        duration = duration_ms(spec["duration"]) if "duration" in spec else 0
        return cls(kind.lower(), ttl, duration, int(spec.get("min_samples", 1)), d.get("time_format"))


@dataclass(frozen=True)
class TruthMapping:
    """Values that count as true and as false. Without false values whatever isn't true is 0."""

    true: tuple = ()
    false: tuple = ()

    @classmethod
    def numeric(cls) -> TruthMapping:
        return cls((1,), (0,))

    @classmethod
    def boolean(cls) -> TruthMapping:
        return cls((True,), (False,))


@dataclass(frozen=True)
class Measurement:
    name: str
    kind: Kind = Kind.MEASURE
    components: tuple[str, ...] = ()
    policy: SignalPolicy | None = None
    sample_rate_ms: int | None = None
    upsample: Upsample | None = None
    downsample: Downsample | None = None
    null_value: Any = None
    null_value_extension: Any = None
    truth: TruthMapping | None = None
    aggregate: Aggregate = Aggregate.AUTO
    temporality: Temporality = Temporality.HISTORICAL

    @property
    def resolved(self) -> Aggregate:
        return self.kind.default_aggregate if self.aggregate is Aggregate.AUTO else self.aggregate


@dataclass(frozen=True)
class Quality:
    name: str
    null_value: Any = None


@dataclass(frozen=True)
class Pointwise:
    """Row-wise: any_on, all_on, count_non_zero, sum, mean, max, min over inputs; difference and ratio of two."""

    op: str
    inputs: tuple[str, ...]
    axis = "pointwise"


@dataclass(frozen=True)
class OverTime:
    """Along a subject's time: derivative, rolling_mean, rolling_sum, lag, lead, cum_sum, diff."""

    op: str
    input: str
    n: int = 1
    unit: str = "s"
    axis = "over_time"

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.input,)


@dataclass(frozen=True)
class OverSubjects:
    """Across subjects at a time: percent_of, rank, z_score, deviation, quantile, bucket."""

    op: str
    input: str
    n: int = 10
    breaks: tuple[float, ...] = ()
    descending: bool = True
    axis = "over_subjects"

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.input,)


@dataclass(frozen=True)
class Derivation:
    name: str
    expr: Pointwise | OverTime | OverSubjects
    kind: Kind | None = None

    @property
    def resolved_kind(self) -> Kind:
        """Flags become categories, counts of non-zero inputs become counts, everything else is a measure."""
        op = self.expr.op
        inferred = Kind.CATEGORICAL if op in ("any_on", "all_on") else Kind.COUNT if op == "count_non_zero" else Kind.MEASURE
        return self.kind or inferred


@dataclass(frozen=True)
class Schema:
    name: str
    subject: str
    time: str
    measurements: tuple[Measurement, ...] = ()
    qualities: tuple[Quality, ...] = ()
    derivations: tuple[Derivation, ...] = ()

    def measurement(self, name: str) -> Measurement | None:
        return next((m for m in self.measurements if m.name == name), None)

    def quality(self, name: str) -> Quality | None:
        return next((q for q in self.qualities if q.name == name), None)

    def derivation(self, name: str) -> Derivation | None:
        return next((d for d in self.derivations if d.name == name), None)

    def validated(self, strict: bool = True) -> Schema:
        """This schema, or a SchemaError. ``strict`` wants a policy and a sample rate for each measurement."""
        if not self.subject or not self.time:
            raise SchemaError("a schema needs a subject and a time column")
        names = [x.name for x in (*self.measurements, *self.qualities, *self.derivations)]
        if len(names) != len(set(names)):
            raise SchemaError(f"names repeat: {sorted({n for n in names if names.count(n) > 1})}")
        for m in self.measurements:
            if strict and (m.policy is None or not m.sample_rate_ms):
                raise SchemaError(f"{m.name} needs a signal policy and a sample rate")
            numeric = m.kind in (Kind.COUNT, Kind.MEASURE, Kind.AVERAGE)
            for fill in (m.null_value, m.null_value_extension):
                if fill is not None and numeric and (isinstance(fill, (str, bool))):
                    raise SchemaError(f"{m.name} is numeric; {fill!r} can't fill it")
        known = {m.name for m in self.measurements} | {d.name for d in self.derivations}
        for d in self.derivations:
            if missing := [i for i in d.expr.inputs if i not in known]:
                raise SchemaError(f"{d.name} needs {missing}, which the schema lacks")
        self.derivation_order([d.name for d in self.derivations])
        return self

    def derivation_order(self, wanted: list[str]) -> list[Derivation]:
        """The derivations that ``wanted`` needs, inputs first; a cycle is a SchemaError."""
        done: list[Derivation] = []
        path: list[str] = []

        def visit(name: str) -> None:
            d = self.derivation(name)
            if d is None or d in done:
                return
            if name in path:
                raise SchemaError(f"derivations form a cycle: {' -> '.join([*path, name])}")
            path.append(name)
            for i in d.expr.inputs:
                visit(i)
            path.pop()
            done.append(d)

        for name in wanted:
            visit(name)
        return done

    def closure(self, wanted: list[str]) -> list[str]:
        """Measurements that the wanted names need, themselves or through derivations, in schema order."""
        order = self.derivation_order(wanted)
        needed = {*wanted, *(i for d in order for i in d.expr.inputs)}
        return [m.name for m in self.measurements if m.name in needed]

    def combine(self, other: Schema) -> Schema:
        """Both schemas' columns; a name with two definitions is a SchemaError."""
        if (self.subject, self.time) != (other.subject, other.time):
            raise SchemaError("schemas with other subjects or times can't be combined")

        def merged(a, b):
            by = {x.name: x for x in a}
            for x in b:
                if by.setdefault(x.name, x) != x:
                    raise SchemaError(f"{x.name} is defined twice, differently")
            return tuple(by.values())

        return replace(self, measurements=merged(self.measurements, other.measurements), qualities=merged(self.qualities, other.qualities), derivations=merged(self.derivations, other.derivations)).validated(strict=False)

    @classmethod
    def from_json(cls, text: str | dict) -> Schema:
        """A schema from JSON text. Policies are instant or sliding there, derivations row-wise; rates are optional."""
        d = json.loads(text) if isinstance(text, str) else dict(text)

        def measure(x: dict) -> Measurement:
            policy = SignalPolicy.from_json(x["signal_policy"]) if x.get("signal_policy") else None
            return Measurement(x["name"], Kind(x.get("kind", "measure").lower()), tuple(x.get("components", ())), policy, x.get("sample_rate_ms"))

        def derived(x: dict) -> Derivation:
            spec = x.get("computation", x.get("pointwise", x.get("expr")))
            spec = spec.get("pointwise", spec)
            if "type" in spec:  # {"type": "sum", "inputs": [...]}, or two named inputs
                op, inputs = spec["type"], spec.get("inputs") or [v for k, v in spec.items() if k != "type"]
            else:  # {"sum": [...]}
                op, inputs = next(iter(spec.items()))
                inputs = list(inputs.values()) if isinstance(inputs, dict) else inputs
            kind = Kind(x["kind"].lower()) if x.get("kind") else None
            return Derivation(x["name"], Pointwise(op.lower(), tuple(inputs)), kind)

        names = lambda xs: [x if isinstance(x, dict) else {"name": x} for x in xs]
        return cls(
            d.get("name", ""), d["subject"], d["time"],
            tuple(measure(x) for x in names(d.get("measurements", d.get("measures", [])))),
            tuple(Quality(x["name"], x.get("null_value")) for x in names(d.get("qualities", []))),
            tuple(derived(x) for x in d.get("derivations", [])),
        ).validated(strict=False)


@dataclass(frozen=True)
class SubjectFilter:
    include: tuple = ()
    exclude: tuple = ()


@dataclass(frozen=True)
class TimeRange:
    """start <= t < end; either end may be open. Bounds are datetimes or ISO strings."""

    start: Any = None
    end: Any = None

    @classmethod
    def last(cls, now, hours: float = 0, days: float = 0) -> TimeRange:
        from datetime import timedelta

        return cls(now - timedelta(hours=hours, days=days), now)


@dataclass(frozen=True)
class ReportInterval:
    """Calendar buckets: unit months, weeks, days, hours, or fixed (then count is milliseconds).

    ``empty`` is what a bucket without observations holds; ``empty_from_config`` takes each measurement's own null value.
    """

    unit: str
    count: int = 1
    strategy: str = "auto"
    overrides: dict = field(default_factory=dict)
    empty: Any = None
    empty_from_config: bool = False
    stats: bool = True

    @property
    def approximate_ms(self) -> int:
        return {"months": 30 * 86_400_000, "weeks": 604_800_000, "days": 86_400_000, "hours": 3_600_000, "fixed": 1}[self.unit] * self.count

    @classmethod
    def from_json(cls, d: dict) -> ReportInterval:
        """``{"bucket": {"type": "months", "count": 3}, "strategy", "aggregation_override", "empty_bucket"}``; also
        ``{"months": 3}`` and ``{"type": "fixed", "duration_ms": 1}``."""
        bucket = dict(d["bucket"])
        unit = bucket.pop("type", None) or next(iter(bucket))
        count = bucket.get("duration_ms", bucket.get("count", bucket.get(unit, 1)))
        empty = d.get("empty_bucket") or {"type": "null"}
        if empty.get("type") not in ("null", "from_config", "value"):
            raise RequestError(f"unknown policy for empty buckets: {empty}")
        overrides = {k: Aggregate(v) for k, v in (d.get("aggregation_override") or {}).items()}
        made = cls(unit, int(count if not isinstance(count, dict) else count["duration_ms"]), d.get("strategy", "auto"), overrides, empty.get("value"), empty["type"] == "from_config")
        made.approximate_ms  # noqa: B018  an unknown unit fails here
        return made


@dataclass(frozen=True)
class SyntheticSubject:
    """A made-up subject that aggregates over the others at each time, or at each time and value of a quality or component.

    ``group_by`` names qualities, ``by_component`` a component, ``where`` holds the component values that count. A
    name's ``{quality}``, ``{component}`` and ``{<column>}`` are filled in. With a component in play, measurements that
    lack it are null.
    """

    name: str
    default: Aggregate = Aggregate.AUTO
    rules: dict = field(default_factory=dict)
    group_by: tuple[str, ...] = ()
    by_component: str | None = None
    where: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, d: dict) -> SyntheticSubject:
        by = d.get("group_by_quality") or ()
        rules = {k: Aggregate(v) for k, v in (d.get("rules") or {}).items()}
        return cls(d["name_pattern"], Aggregate(d.get("default_rule") or "auto"), rules, (by,) if isinstance(by, str) else tuple(by), d.get("group_by_component"), dict(d.get("component_filters") or {}))


def _levels(d: dict | None) -> dict:
    """Component filters of JSON: {component: {"levels": "All" | {"Include": [...]} | {"Exclude": [...]}}}."""
    out = {}
    for component, by in ((d or {}).get("filters", d) or {}).items():
        levels = by.get("levels", by) if isinstance(by, dict) else by
        if isinstance(levels, str) and levels.lower() == "all":
            out[component] = {}
        elif isinstance(levels, dict) and {k.lower() for k in levels} <= {"include", "exclude"}:
            out[component] = {k.lower(): list(v) for k, v in levels.items()}
        else:
            raise RequestError(f"unknown filter of {component}: {by}")
    return out


@dataclass(frozen=True)
class SubsetRequest:
    """``aggregation`` replaces how a measurement is reduced over components, in reports and in synthetic subjects."""

    measurements: tuple[str, ...] = ()
    qualities: tuple[str, ...] = ()
    subjects: SubjectFilter | None = None
    quality_filter: dict = field(default_factory=dict)
    component_filter: dict = field(default_factory=dict)
    time_range: TimeRange | None = None
    interval_ms: int | None = None
    synthetic: tuple[SyntheticSubject, ...] = ()
    report: ReportInterval | None = None
    aggregation: dict = field(default_factory=dict)

    #: Fields of a JSON request; any other one but a note is an error.
    FIELDS = ("measurements", "qualities", "subject_filter", "quality_filter", "time_range", "component_filters", "aggregation_override", "synthetic_subjects", "interval", "report_interval", "NOTE")

    @classmethod
    def from_json(cls, text: str | dict) -> SubsetRequest:
        d = json.loads(text) if isinstance(text, str) else dict(text)
        if unread := [f for f in d if f not in cls.FIELDS]:
            raise RequestError(f"not a field of a request: {unread}")
        subjects = None
        if f := d.get("subject_filter"):
            kind = f.get("type", "Include").lower()
            if kind not in ("include", "exclude"):
                raise RequestError(f"unknown subject filter: {f}")
            subjects = SubjectFilter(**{kind: tuple(f.get("values", ()))})
        span = d.get("time_range") or {}
        interval = d.get("interval")
        quality = {q["quality"]: list(q["values"]) for q in ([d["quality_filter"]] if d.get("quality_filter") else [])}
        override = d.get("aggregation_override") or {}
        return cls(
            tuple(d.get("measurements", ())), tuple(d.get("qualities", ())), subjects, quality, _levels(d.get("component_filters")),
            TimeRange(span.get("start"), span.get("end")) if span else None, duration_ms(interval) if interval else None,
            tuple(SyntheticSubject.from_json(x) for x in d.get("synthetic_subjects") or ()),
            ReportInterval.from_json(d["report_interval"]) if d.get("report_interval") else None,
            {k: Aggregate(v) for k, v in override.get("overrides", override).items()},
        )
