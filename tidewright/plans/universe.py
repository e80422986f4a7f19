"""Build once, query many: a universe of bound sources answers subset requests with lazy frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.aggregates import aggregate
from ..functions.calendar import bucket_start
from ..functions.expr import fill, java_pattern, pointwise, truth
from ..functions.windows import over_subjects, over_time
from ..model import Aggregate, Kind, Measurement, Schema, SubsetRequest, SyntheticSubject, Temporality
from ..operators import align as A
from ..operators import relational as R
from ..operators.materialize import cut
from ..sources.bind import BoundSource
from . import planner


@dataclass
class Fragment:
    source: str
    df: DataFrame


@dataclass
class Subset:
    """A result and what it was made from. Counts are computed only when asked for."""

    df: DataFrame
    subject: str
    time: str
    interval_ms: int | None
    notes: list[str] = field(default_factory=list)

    def info(self) -> dict:
        """Rows, subjects and times; for a report also each value's contributing and missing cells (``interval_stats``)."""
        counted = [c.removesuffix("_null_count") for c in self.df.columns if c.endswith("_null_count")]
        sums = [F.sum(f"{v}_{k}").alias(f"{v}_{k}") for v in counted for k in ("n", "null_count")]
        row = self.df.agg(F.count("*").alias("rows"), F.count_distinct(self.subject).alias("subjects"), F.count_distinct(self.time).alias("times"), *sums).first().asDict()
        stats = {v: {"n": row.pop(f"{v}_n") or 0, "null_count": row.pop(f"{v}_null_count") or 0} for v in counted}
        return row | ({"interval_stats": stats} if counted else {})


@dataclass
class Part:
    """Units of one source after their policy: ``signal`` (with components), ``crushed`` (without), and each subject's
    first and last observed time (``extent``: subject, low, high)."""

    group: list[Measurement]
    components: list[str]
    signal: DataFrame
    crushed: DataFrame
    extent: DataFrame


class Universe:
    def __init__(self, schema: Schema, measures: dict[str, list[Fragment]], qualities: dict[str, DataFrame], now: datetime | None = None, sources: dict[str, DataFrame] | None = None, overlap: str = "keep_all", priorities: dict[str, int] | None = None):
        self.schema, self.measures, self.qualities = schema, measures, qualities
        self.sources = sources or {}
        self.now = now
        self.alignment: planner.Alignment | None = None
        self.overlap, self.priorities = overlap, priorities or {}

    @classmethod
    def build(cls, schema: Schema, sources: Sequence[BoundSource], now: datetime | None = None, overlap: str = "keep_all") -> Universe:
        """Bind sources to the schema; a source that says what it provides gives nothing else.

        Several sources of a measurement stack. ``overlap`` says what happens to rows that two of them have at one
        subject, time and component: keep_all, first_wins or last_wins by priority (lowest first), or error. A quality
        is taken from the first source by priority that has a value for the subject.
        """
        measures: dict[str, list[Fragment]] = {}
        found: dict[str, list[DataFrame]] = {}
        whole: dict[str, DataFrame] = {}
        ordered = sorted(sources, key=lambda s: s.priority)
        for source in ordered:
            frame = source.validated(schema).canonical()
            whole[source.name] = frame
            has_time = schema.time in frame.columns
            gives = lambda name: name in frame.columns and (not source.provides or name in source.provides)  # noqa: B023, E731
            for m in schema.measurements:
                if has_time and gives(m.name):
                    keys = [schema.subject, schema.time, *(c for c in m.components if c in frame.columns)]
                    measures.setdefault(m.name, []).append(Fragment(source.name, frame.select(*keys, m.name)))
            for u in source.unpivots:
                long = u.run(frame, [schema.subject, schema.time])
                measures.setdefault(u.measure, []).append(Fragment(f"{source.name}/{u.measure}", long))
            for q in schema.qualities:
                if gives(q.name):
                    found.setdefault(q.name, []).append(frame.select(schema.subject, q.name, F.lit(len(found.get(q.name, []))).alias("__at")))
        qualities = {}
        for q in schema.qualities:
            if q.name in found:
                rows = reduce(lambda a, b: a.unionByName(b), found[q.name])
                first = F.min(F.when(F.col(q.name).isNotNull(), F.struct("__at", q.name)))[q.name]
                one = rows.groupBy(schema.subject).agg(first.alias(q.name))
                qualities[q.name] = one.withColumn(q.name, fill(F.col(q.name), q.null_value))
        return cls(schema, measures, qualities, now, whole, overlap, {s.name: k for k, s in enumerate(ordered)})

    def ensure_aligned(self, names: Sequence[str] | None = None) -> Universe:
        units = [m for m in self.schema.measurements if m.name in (names or self.measures)]
        self.alignment = planner.align(units)
        return self

    # -- pieces ----------------------------------------------------------------------------------------------

    def _narrow(self, df: DataFrame, m: Measurement, req: SubsetRequest) -> DataFrame:
        """Times parsed where the policy says how, and the request's filters. Forecasts keep a row at the end."""
        s = self.schema
        if m.policy and m.policy.time_format:
            df = df.withColumn(s.time, F.try_to_timestamp(F.col(s.time), F.lit(java_pattern(m.policy.time_format))).cast("timestamp_ntz"))
        df = R.filter_time(R.filter_subjects(df, s.subject, req.subjects), s.time, req.time_range, m.temporality is Temporality.FORECAST)
        return R.filter_levels(df, {c: by for c, by in req.component_filter.items() if c in df.columns})

    def _raw(self, m: Measurement, req: SubsetRequest) -> DataFrame:
        """A measurement's rows: filtered, stacked, truth-mapped, with nulls filled."""
        s = self.schema
        frames = {f.source: self._narrow(f.df, m, req) for f in self.measures[m.name]}
        df = next(iter(frames.values())) if len(frames) == 1 else R.stack(list(frames.values()), [s.subject, s.time], m.name, m.components, self._how(m, req), self.overlap, [self.priorities.get(n.split("/")[0], 0) for n in frames])
        value = F.col(m.name) if m.truth is None else truth(m.name, m.truth)
        return df.withColumn(m.name, fill(value, m.null_value))

    def _how(self, m: Measurement, req: SubsetRequest) -> Aggregate:
        return req.aggregation.get(m.name, m.resolved)

    def _components(self, m: Measurement) -> list[str]:
        return [c for c in m.components if all(c in f.df.columns for f in self.measures[m.name])]

    def _rows(self, group: list[Measurement], req: SubsetRequest) -> DataFrame:
        """Rows of one unit, or several columns of one source by one scan and one filter."""
        if len(group) == 1:
            return self._raw(group[0], req)
        df = self._narrow(self.sources[self.measures[group[0].name][0].source], group[0], req)
        return df.withColumns({m.name: fill(F.col(m.name) if m.truth is None else truth(m.name, m.truth), m.null_value) for m in group})

    def _part(self, group: list[Measurement], req: SubsetRequest) -> Part:
        """The units of a group after their policy.

        An instant policy reads its source once: cells with their first and last times are checkpointed, and the grid,
        its bounds, the keys and the carried values all come from them.
        """
        s, first, names = self.schema, group[0], [m.name for m in group]
        comps = self._components(first)
        keys = [s.subject, *comps]
        df, policy = self._rows(group, req), first.policy
        if policy and policy.kind == "instant":
            text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
            hows = {m.name: A.instant_aggregate(m.kind, m.aggregate, m.name in text) for m in group}
            rate = first.sample_rate_ms or policy.ttl
            # Ranks and breaks compare values bit by bit.
            exact = any(d.expr.axis == "over_subjects" and d.expr.op in ("rank", "quantile", "bucket") for d in s.derivation_order(list(req.measurements)))
            cells = cut(A.instant_cells(df, s.time, hows, keys, rate, exact))
            extent = cells.groupBy(s.subject).agg(F.min("__low").alias("low"), F.max("__high").alias("high"))
            out = A.instant_of_cells(cells, s.time, names, keys, rate, policy.ttl)
        else:
            extent = cut(df.groupBy(s.subject).agg(F.min(s.time).alias("low"), F.max(s.time).alias("high")))
            if policy is None:
                out = df.select(*keys, s.time, *names)
            elif policy.kind == "sliding":
                out = A.sliding(df, s.time, first.name, keys, policy.duration, first.resolved, policy.min_samples)
            else:
                out = A.tumbling(df, s.time, first.name, keys, policy.duration, first.resolved, policy.min_samples)
        out = out.withColumns({m.name: fill(F.col(m.name), m.null_value) for m in group})
        if self.alignment and (action := self.alignment.actions.get(first.name)) in ("upsample", "downsample"):
            hows = {m.name: m.upsample if action == "upsample" else m.downsample or _down(m) for m in group}
            out = A.resample_wide(out.select(*keys, s.time, *names), s.time, hows, keys, self.alignment.rate_ms)
        crushed = R.crush(out, [s.subject, s.time], {m.name: self._how(m, req) for m in group}, comps) if comps else out
        return Part(group, comps, out, crushed, extent)

    def _groups(self, units: list[Measurement]) -> list[list[Measurement]]:
        """Units of one source frame go together unless they are stacked or unpivoted."""
        single = {m.name: self.measures[m.name][0].source for m in units if len(self.measures[m.name]) == 1 and "/" not in self.measures[m.name][0].source}
        return planner.join_groups(units, single)

    def _resolve(self, req: SubsetRequest) -> list[Measurement]:
        s = self.schema
        for name in req.measurements:
            if not (s.measurement(name) or s.derivation(name)):
                raise RequestError(f"unknown measurement: {name}")
        for name in req.qualities:
            if name not in self.qualities:
                raise RequestError(f"unknown quality: {name}")
        units = [s.measurement(n) for n in s.closure(list(req.measurements))]
        if missing := [m.name for m in units if m.name not in self.measures]:
            raise RequestError(f"no source has {missing}")
        return units

    def _with_qualities(self, df: DataFrame, req: SubsetRequest) -> DataFrame:
        s = self.schema
        for name in dict.fromkeys([*req.qualities, *req.quality_filter]):
            q = s.quality(name)
            df = df.join(self.qualities[name], s.subject, "left").withColumn(name, fill(F.col(name), q.null_value if q else None))
        for name, values in req.quality_filter.items():
            df = df.where(F.col(name).isin(*values))
        return df

    def _derived(self, df: DataFrame, req: SubsetRequest) -> DataFrame:
        s = self.schema
        for d in s.derivation_order(list(req.measurements)):
            if d.expr.axis == "over_subjects":
                df = over_subjects(df, d.expr, s.subject, s.time, d.name)
            else:
                df = df.withColumn(d.name, pointwise(d.expr) if d.expr.axis == "pointwise" else over_time(d.expr, s.subject, s.time))
        return df

    def _aggregates(self, req: SubsetRequest) -> dict[str, Aggregate]:
        s = self.schema
        found = {}
        for n in req.measurements:
            m, d = s.measurement(n), s.derivation(n)
            found[n] = req.aggregation.get(n, m.resolved if m else d.resolved_kind.default_aggregate)
        return found

    # -- requests --------------------------------------------------------------------------------------------

    def qualities_only(self, req: SubsetRequest) -> DataFrame:
        """Subjects that have any of the qualities, with all of them."""
        s = self.schema
        frames = [R.filter_subjects(self.qualities[q], s.subject, req.subjects) for q in dict.fromkeys([*req.qualities, *req.quality_filter])]
        df = reduce(lambda a, b: a.join(b, s.subject, "full"), frames)
        for name, values in req.quality_filter.items():
            df = df.where(F.col(name).isin(*values))
        return df.select(s.subject, *req.qualities)

    def subset(self, req: SubsetRequest) -> Subset:
        """Aligned result: subject x grid time, requested columns only."""
        s = self.schema
        units = self._resolve(req)
        if not req.measurements:
            if not req.qualities:
                raise RequestError("an empty request")
            return Subset(self.qualities_only(req), s.subject, s.subject, None)
        step = planner.grid_interval(units, self.alignment, req.interval_ms)
        parts = [self._part(g, req) for g in self._groups(units)]
        notes = []
        out = self._grid(parts, step)
        for part in parts:
            g = part.group
            rate = self.alignment.rate_ms if self.alignment else g[0].sample_rate_ms
            kind = "equi" if rate == step else "asof"
            notes.append(f"{'+'.join(m.name for m in g)}: {kind}")
            if kind == "equi":
                out = out.join(part.crushed, [s.subject, s.time], "left")
            else:
                out = A.asof(out, part.crushed, s.time, [s.subject], [m.name for m in g], (g[0].policy.ttl if g[0].policy else step))
            out = out.withColumns({m.name: fill(F.col(m.name), m.null_value_extension) for m in g})
        out = self._derived(self._with_qualities(out, req), req)
        out = R.filter_subjects(out, s.subject, req.subjects)
        if all(m.temporality is Temporality.HISTORICAL for m in units):
            out = R.filter_time(out, s.time, req.time_range)
        out = out.select(s.subject, s.time, *req.measurements, *req.qualities)
        values = self._aggregates(req)
        if req.report:
            # Statistics are of measurements; a request for derivations alone has nothing to put into buckets.
            values = {n: a for n, a in values.items() if s.measurement(n)}
            if not values:
                return Subset(self._with_synthetic(out, parts, req, self._aggregates(req)), s.subject, s.time, step, [*notes, "derivations only: not put into buckets"])
            configured = {n: s.measurement(n).null_value for n in values}
            reported = A.report(out, req.report, s.subject, s.time, values, configured)
            # Over the report's rows; qualities are there only to group by.
            both = self._with_synthetic(reported, parts, req, values)
            return Subset(both.select(*reported.columns), s.subject, s.time, req.report.approximate_ms, notes)
        return Subset(self._with_synthetic(out, parts, req, values), s.subject, s.time, step, notes)

    def _with_synthetic(self, df: DataFrame, parts: list[Part], req: SubsetRequest, values: dict[str, Aggregate]) -> DataFrame:
        """``df`` and the rows of the request's synthetic subjects."""
        s = self.schema
        plain = [x for x in req.synthetic if not (x.by_component or x.where)]
        base = df
        for name in dict.fromkeys(g for x in plain for g in x.group_by if g not in df.columns):
            base = self._quality_of(base, name)
        out = R.add_synthetic(base, plain, s.subject, s.time, values) if plain else df
        for spec in req.synthetic:
            if spec not in plain:
                out = out.withColumn(s.subject, F.col(s.subject).cast("string")).unionByName(self._by_component(spec, parts, req, values), allowMissingColumns=True)
        return out

    def _quality_of(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.qualities:
            raise RequestError(f"unknown quality: {name}")
        q = self.schema.quality(name)
        return df.join(self.qualities[name], self.schema.subject, "left").withColumn(name, fill(F.col(name), q.null_value))

    def _by_component(self, spec: SyntheticSubject, parts: list[Part], req: SubsetRequest, values: dict[str, Aggregate]) -> DataFrame:
        """Rows of a synthetic subject over the components of measurements, as they are before these are crushed.

        Levels are reduced to one value a subject [and level] first, then subjects to one value.
        """
        s = self.schema
        wanted = {*spec.where, *([spec.by_component] if spec.by_component else [])}
        level = [spec.by_component] if spec.by_component else []
        frames = []
        for part in parts:
            names = {m.name: self._how(m, req) for m in part.group if m.name in values}
            if not names or not wanted <= {*part.components}:
                continue
            rows = part.signal
            for c, value in spec.where.items():
                rows = rows.where(F.col(c).cast("string") == str(value))
            if all(m.temporality is Temporality.HISTORICAL for m in part.group):
                rows = R.filter_time(rows, s.time, req.time_range)
            one = R.crush(rows, [s.subject, s.time, *level], names, part.components)
            if req.report:
                one = one.withColumn(s.time, bucket_start(s.time, req.report.unit, req.report.count)).groupBy(s.subject, s.time, *level).agg(*[aggregate(n, req.report.overrides.get(n, how), s.time).alias(n) for n, how in names.items()])
            for name in spec.group_by:
                one = self._quality_of(one, name)
            frames.append(R.synthetic_rows(one, spec, s.subject, s.time, {n: values[n] for n in names}))
        if not frames:
            raise RequestError(f"no requested measurement has the components {sorted(wanted)}")
        made = reduce(lambda a, b: a.join(b, [s.subject, s.time, *spec.group_by, *level], "full"), frames)
        return made.drop(*level)

    def _grid(self, parts: list[Part], step_ms: int) -> DataFrame:
        """Distinct subjects x time points. Historical ends are clipped to the clock; forecasts keep theirs."""
        s = self.schema
        now = F.lit(self.now or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        spans = []
        for part in parts:
            high = F.max("high")
            spans.append(part.extent.agg(F.min("low").alias("low"), (F.least(high, now) if part.group[0].temporality is Temporality.HISTORICAL else high).alias("high")))
        bounds = reduce(lambda a, b: a.unionByName(b), spans).agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
        subjects = reduce(lambda a, b: a.unionByName(b), [part.extent.select(s.subject) for part in parts]).distinct()
        return A.explode_cells(subjects.join(F.broadcast(bounds)), "__low", "__high", step_ms, s.time)  # one row

    def subset_raw(self, req: SubsetRequest) -> Subset:
        """Observed rows only: filtered, crushed over components, joined in full on subject and time."""
        s = self.schema
        frames = []
        for m in self._resolve(req):
            raw = self._raw(m, req)
            how = self._how(m, req)
            frames.append(raw.groupBy(s.subject, s.time).agg(aggregate(m.name, how, F.struct(*[F.col(c) for c in self._components(m)]) if self._components(m) else s.time).alias(m.name)))
        out = reduce(lambda a, b: a.join(b, [s.subject, s.time], "full"), frames)
        out = self._derived(self._with_qualities(out, req), req)
        return Subset(out.select(s.subject, s.time, *req.measurements, *req.qualities).orderBy(s.subject, s.time), s.subject, s.time, None)

    def write_qualities(self, path: str) -> None:
        """All qualities as one Parquet table, a row for each subject that has any."""
        frames = list(self.qualities.values())
        reduce(lambda a, b: a.join(b, self.schema.subject, "full"), frames).write.mode("overwrite").parquet(path)

    def describe(self) -> dict[str, dict]:
        """What each measurement was built from, and which components sources lacked."""
        found = {}
        for name, fragments in self.measures.items():
            declared = self.schema.measurement(name).components
            found[name] = {"sources": [f.source for f in fragments], "components": self._components(self.schema.measurement(name)), "crushed": sorted({c for f in fragments for c in declared if c not in f.df.columns})}
        return found

    def memory_summary(self) -> dict[str, int]:
        """Bytes that the optimiser expects of each source, measurement and quality; no job runs."""
        size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        found = {f"source {n}": size(df) for n, df in self.sources.items()}
        found |= {f"measurement {n}": sum(size(f.df) for f in fs) for n, fs in self.measures.items()}
        return found | {f"quality {n}": size(df) for n, df in self.qualities.items()}

    def diagnostics(self, names: Sequence[str] | None = None) -> DataFrame:
        """For each measurement: rows, nulls, subjects, and first and last time, as stored."""
        s, out = self.schema, []
        for name in names or list(self.measures):
            rows = self._raw(s.measurement(name), SubsetRequest((name,)))
            out.append(rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col(name).isNull()).alias("n_null"), F.count_distinct(s.subject).alias("n_subjects"), F.min(s.time).alias("first_time"), F.max(s.time).alias("last_time")).select(F.lit(name).alias("measurement"), "*"))
        return reduce(lambda a, b: a.unionByName(b), out)

    def execute(self, requests: Sequence[SubsetRequest]) -> list[Subset]:
        return [self.subset(r) for r in requests]


def _down(m: Measurement):
    from ..model import Downsample

    return {Kind.COUNT: Downsample.SUM, Kind.CATEGORICAL: Downsample.LAST, Kind.BINARY: Downsample.MAX}.get(m.kind, Downsample.MEAN)
