"""Synthetic subjects and measurements, made in the cluster: every row's draws come from its own seed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..causal.config import Campaign


@dataclass(frozen=True)
class Distribution:
    """constant, uniform, normal, log_normal, poisson, negative_binomial, categorical, uniform_choice, bernoulli."""

    kind: str
    a: float = 0.0
    b: float = 1.0
    weights: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Shape:
    """Factor by month: constant, linear (1 + slope * month) or seasonal (1 + amplitude * sin)."""

    kind: str = "constant"
    amount: float = 0.0
    period: float = 12.0

    def factor(self, month: Column) -> Column:
        if self.kind == "linear":
            return F.greatest(1 + F.lit(self.amount) * month, F.lit(0.0))
        if self.kind == "seasonal":
            return F.greatest(1 + F.lit(self.amount) * F.sin(month * (2 * 3.141592653589793 / self.period)), F.lit(0.0))
        return F.lit(1.0)


def unit(seed: int, *parts: Column | str) -> Column:
    """A uniform number in (0, 1) from a hash, the same in every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *parts: Column | str) -> Column:
    return F.sqrt(-2 * F.log(unit(seed, *parts))) * F.cos(6.283185307179586 * unit(seed + 1_000_003, *parts))


def choice(weights: dict[str, float], u: Column) -> Column:
    """A level by cumulative weight."""
    total, at, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        at += weights[name] / total
        out = F.when(u < at, F.lit(name)) if out is None else out.when(u < at, F.lit(name))
    return out.otherwise(F.lit(names[-1])) if out is not None else F.lit(names[0])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def gamma(shape: float, seed: int, parts: Sequence[Column | str]) -> Column:
    """A gamma draw of scale 1 by Marsaglia and Tsang's rejection; all of 12 candidates fail in fewer than 1e-15 cases."""
    a = shape if shape >= 1 else shape + 1
    d = a - 1 / 3

    def candidate(i: Column) -> Column:
        fits = lambda x, v: (v > 0) & (F.log(unit(seed + 17, *parts, i)) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        return let(normal(seed, *parts, i), lambda x: let((1 + x / (9 * d) ** 0.5) ** 3, lambda v: F.when(fits(x, v), d * v)))

    draw = F.coalesce(*[candidate(F.lit(i)) for i in range(12)])  # stops at the first that fits
    return draw if shape >= 1 else draw * unit(seed + 19, *parts) ** (1 / shape)


def poisson(mean: Column, seed: int, parts: Sequence[Column | str]) -> Column:
    """A Poisson draw: the sum of draws of means up to 16, each counted up along its cumulative law to 64, beyond which
    less than 1e-17 of it lies. Means over 128 take a rounded normal with their skewness. Counting goes on beyond
    2 + 1.5 * mean for the few draws that lie there."""

    def part(m: Column, u: Column) -> Column:
        # State: the law up to i - 1, its next term, and how many of the sums before are less than u.
        start = let(F.exp(-m), lambda p: F.struct((p * m).alias("p"), p.alias("cdf"), F.lit(0.0).alias("n")))
        less = lambda s: s["n"] + F.when(u > s["cdf"], 1.0).otherwise(0.0)
        step = lambda s, i: F.struct((s["p"] * m / (i + 1)).alias("p"), (s["cdf"] + s["p"]).alias("cdf"), less(s).alias("n"))
        near = F.least(2 + F.ceil(1.5 * m), F.lit(64)).cast("int")
        rest = lambda s: F.when((u > s["cdf"]) & (near < 64), F.aggregate(F.sequence(near + 1, F.lit(64)), s, step, less)).otherwise(less(s))
        return F.aggregate(F.sequence(F.lit(1), near), start, step, rest)

    def counted(m: Column) -> Column:
        count = F.ceil(m / 16)
        each = lambda i: let(unit(seed, *parts, i), lambda u: let(m / count, lambda share: part(share, u)))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), count), F.lit(0.0), lambda n, i: n + each(i))

    def large(m: Column) -> Column:
        z = normal(seed, *parts)
        return let(z, lambda x: F.greatest(F.round(m + F.sqrt(m) * x + (x * x - 1) / 6), F.lit(0.0)))

    return let(mean, lambda m: F.when(m <= 0, 0.0).when(m <= 128, counted(m)).otherwise(large(m)))


def numeric(d: Distribution, seed: int, parts: Sequence[Column | str], scale: Column | None = None) -> Column:
    """A draw; ``scale`` multiplies the mean. A negative binomial draw is a Poisson one with a gamma mean of shape b."""
    k = scale if scale is not None else F.lit(1.0)
    u = unit(seed, *parts)
    if d.kind == "constant":
        return F.lit(d.a) * k
    if d.kind == "uniform":
        return (F.lit(d.a) + (d.b - d.a) * u) * k
    if d.kind == "normal":
        return (F.lit(d.a) + d.b * normal(seed, *parts)) * k
    if d.kind == "log_normal":
        return F.exp(F.lit(d.a) + d.b * normal(seed, *parts)) * k
    if d.kind == "bernoulli":
        return (u < d.a).cast("double")
    mean = F.lit(d.a) * k
    if d.kind == "negative_binomial":
        return poisson(mean * gamma(d.b, seed + 7, parts) / d.b, seed, parts)
    if d.kind != "poisson":
        raise ValueError(f"not a numeric distribution: {d.kind}")
    return poisson(mean, seed, parts)


@dataclass(frozen=True)
class MeasureSpec:
    distribution: Distribution
    shape: Shape = Shape()
    component: str | None = None
    levels: dict[str, float] = field(default_factory=dict)


def subjects(spark: SparkSession, n: int, qualities: dict[str, Distribution], derived: dict[str, tuple[str, dict[str, str]]] | None = None, scale: Distribution = Distribution("log_normal", 0.0, 0.5), seed: int = 42, subject: str = "npi") -> DataFrame:
    """Subjects with qualities; ``derived`` maps a quality to (parent, {value: value}), other values pass."""
    df = spark.range(n).select(F.concat(F.lit("NPI-"), (F.col("id") + 1_000_000).cast("string")).alias(subject), F.col("id").alias("__id"))
    df = df.withColumn("volume_scale", numeric(scale, seed, ["__id"]))
    for k, (name, d) in enumerate(qualities.items()):
        weights = d.weights if d.kind != "uniform_choice" else dict.fromkeys(d.weights, 1.0)
        df = df.withColumn(name, choice(weights, unit(seed + 100 + k, "__id")))
    for name, (parent, mapping) in (derived or {}).items():
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
        df = df.withColumn(name, F.coalesce(table[F.col(parent)], F.col(parent)) if table is not None else F.col(parent))
    return df.drop("__id")


def measurement(who: DataFrame, spec: MeasureSpec, months: int, noise: float = 0.1, seed: int = 42, subject: str = "npi", month: str = "mth_cnt") -> DataFrame:
    """(subject, month[, component], value) for months 1..n; a component splits the rounded total multinomially.

    ``who`` has a row a subject, so the parts of a total are counted in its own row, without a shuffle.
    """
    rows = who.select(subject, "volume_scale", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(months).cast("long"))).alias(month))
    parts = [subject, month]
    base = numeric(spec.distribution, seed, parts, F.col("volume_scale") * spec.shape.factor(F.col(month) - 1))
    factor = F.greatest(1 + noise * normal(seed + 13, *parts), F.lit(0.0)) if noise > 0 else F.lit(1.0)
    rows = rows.withColumn("value", F.greatest(base * factor, F.lit(0.0)))
    if not spec.component:
        return rows.select(subject, month, "value")
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.round("value"), F.lit(0.0)).cast("int")), lambda i: choice(spec.levels, unit(seed + 29, *parts, i)))
    drawn = F.when(F.round("value") >= 1, units).otherwise(F.array(choice(spec.levels, unit(seed + 31, *parts))))
    counts = let(drawn, lambda x: F.array(*[F.struct(F.lit(level).alias("c"), F.size(F.filter(x, lambda y: y == level)).cast("double").alias("n")) for level in spec.levels]))
    split = rows.select(subject, month, (F.round("value") >= 1).alias("any"), F.explode(F.filter(counts, lambda x: x["n"] > 0)).alias("x"))
    return split.select(subject, month, F.col("x.c").alias(spec.component), F.when(F.col("any"), F.col("x.n")).otherwise(0.0).alias("value"))


def treat(who: DataFrame, campaign: Campaign, called_if_reached: float = 0.9, called_if_not: float = 0.1, seed: int = 7819, subject: str = "npi") -> DataFrame:
    """Subjects with planned_reach_month, reach_month, reached and called_on.

    Targets are drawn without replacement with weight volume ** 1.5 (the largest keys ln(u) / w); by falling
    volume they get the reach months in turn, and the first share of them is really reached.
    """
    key = F.log(unit(seed, subject)) / F.greatest(F.col("volume_scale") ** 1.5, F.lit(1e-12))
    drawn = who.select(subject, "volume_scale", key.alias("__k")).orderBy(F.col("__k").desc(), subject).limit(campaign.targets)
    place = F.row_number().over(Window.orderBy(F.col("volume_scale").desc(), subject)) - 1  # the target list only
    planned = drawn.select(subject, place.alias("__i")).withColumn("planned_reach_month", (F.lit(campaign.first_reach) + F.col("__i") % campaign.reach_months).cast("long"))
    reached = F.col("__i") < int(campaign.targets * campaign.reach_share)
    out = who.join(planned.withColumn("reach_month", F.when(reached, F.col("planned_reach_month"))).drop("__i"), subject, "left")
    flag = F.col("reach_month").isNotNull()
    called = unit(seed + 3, subject) < F.when(flag, called_if_reached).otherwise(called_if_not)
    return out.withColumns({"reached": flag.cast("long"), "called_on": called.cast("long")})


def apply_lift(facts: DataFrame, treated: DataFrame, lift: float, ramp_months: int, subject: str = "npi", month: str = "mth_cnt", reach: str = "reach_month") -> DataFrame:
    """Values from the reach month on grow linearly to 1 + lift over the ramp, and stay there."""
    since = F.col(month) - F.col(reach)
    ramp = max(1, ramp_months)
    factor = F.when(since.isNull() | (since < 0), 1.0).when(since < ramp, 1 + lift * (since + 1) / ramp).otherwise(1 + lift)
    joined = facts.join(treated.select(subject, reach), subject, "left")
    return joined.withColumn("value", F.col("value") * factor).drop(reach)
