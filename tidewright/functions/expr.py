"""Key expressions, truth mapping and row-wise derivations as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..model import Kind, Pointwise, TruthMapping

#: Strptime directives and the Java patterns that read the same.
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%.f": "[.SSSSSS][.SSS]", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%j": "DDD", "%p": "a", "%I": "hh", "%z": "xx", "%%": "%", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss"}


def java_pattern(fmt: str) -> str:
    """A strptime format as a Java date pattern; other letters are quoted."""
    out, k = "", 0
    while k < len(fmt):
        hit = next((d for d in sorted(STRPTIME, key=len, reverse=True) if fmt.startswith(d, k)), None)
        if hit:
            out += STRPTIME[hit]
            k += len(hit)
        else:
            out += f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]
            k += 1
    return out


@dataclass(frozen=True)
class KeyExpr:
    """A computed key: how to build the column, and which source columns it needs."""

    kind: str
    columns: tuple[str, ...]
    build: object

    def to_column(self, name: str) -> Column:
        return self.build().alias(name)

    @property
    def is_identity(self) -> bool:
        return self.kind == "column"


def column(name: str) -> KeyExpr:
    return KeyExpr("column", (name,), lambda: F.col(name))


def struct_key(*names: str) -> KeyExpr:
    return KeyExpr("struct", names, lambda: F.struct(*[F.col(n) for n in names]))


def concat_key(names: Sequence[str], separator: str = "") -> KeyExpr:
    """Null if any part is null (unlike concat_ws)."""
    def build() -> Column:
        parts: list[Column] = []
        for n in names:
            parts += [F.lit(separator)] * bool(parts) + [F.col(n).cast("string")]
        return F.concat(*parts)

    return KeyExpr("concat", tuple(names), build)


def coalesce_key(*names: str) -> KeyExpr:
    return KeyExpr("coalesce", names, lambda: F.coalesce(*[F.col(n) for n in names]))


def datetime_of(date: str, time: str) -> KeyExpr:
    """A date column and a time-of-day column (time type, or text HH:MM:SS) as one timestamp."""
    return KeyExpr("datetime", (date, time), lambda: F.try_to_timestamp(F.concat(F.col(date).cast("date").cast("string"), F.lit(" "), F.col(time).cast("string"))).cast("timestamp_ntz"))


def datetime_parts(y: str, m: str, d: str, h: str | None = None, mi: str | None = None, s: str | None = None) -> KeyExpr:
    """Parts that aren't given are 0; parts that make no date give null."""
    names = tuple(n for n in (y, m, d, h, mi, s) if n)
    part = lambda n: F.col(n).cast("int") if n else F.lit(0)
    second = F.col(s) if s else F.lit(0)
    return KeyExpr("parts", names, lambda: F.try_make_timestamp_ntz(part(y), part(m), part(d), part(h), part(mi), second))


def parse_datetime(name: str, fmt: str) -> KeyExpr:
    return KeyExpr("parse", (name,), lambda: F.try_to_timestamp(F.col(name), F.lit(java_pattern(fmt))).cast("timestamp_ntz"))


def from_epoch(name: str, unit: str = "ms") -> KeyExpr:
    """Seconds, ms, us or ns since 1970 as a timestamp of microseconds."""
    def build() -> Column:
        v = F.col(name).cast("long")
        micros = {"s": v * 1_000_000, "ms": v * 1000, "us": v, "ns": F.floor(v / 1000).cast("long")}
        if unit not in micros:
            raise RequestError(f"unknown epoch unit: {unit}")
        return F.timestamp_micros(micros[unit]).cast("timestamp_ntz")

    return KeyExpr("epoch", (name,), build)


def truth(value: Column | str, mapping: TruthMapping) -> Column:
    """1 for true values; 0 for false ones, or for all others where no false values are given; else null.

    Values are compared by their own type: text as text, numbers as numbers, booleans as booleans.
    """
    v = F.col(value) if isinstance(value, str) else value
    if not mapping.true:
        return v

    def among(values: Sequence) -> Column:
        tests = []
        for x in values:
            if isinstance(x, bool):
                tests.append(v.try_cast("boolean") == F.lit(x))
            elif isinstance(x, int):
                tests.append(v.try_cast("bigint") == F.lit(x))
            elif isinstance(x, float):
                tests.append(v.try_cast("double") == F.lit(x))
            else:
                tests.append(v.cast("string") == F.lit(x))
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])

    one = F.when(among(mapping.true), F.lit(1))
    if mapping.false:
        return one.when(among(mapping.false), F.lit(0)).cast("int")
    return one.otherwise(F.lit(0)).cast("int")


def fill(value: Column, literal) -> Column:
    return value if literal is None else F.coalesce(value, F.lit(literal))


def pointwise(spec: Pointwise) -> Column:
    """Row-wise derivation. Nulls are left out of flags, counts, sums, means and extremes."""
    cols = [F.col(f"`{c}`") for c in spec.inputs]
    if not cols:
        raise RequestError(f"{spec.op} needs inputs")
    most = F.greatest(*cols) if len(cols) > 1 else cols[0]
    least = F.least(*cols) if len(cols) > 1 else cols[0]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    if spec.op == "any_on":
        return (most > 0).cast("int")
    if spec.op == "all_on":
        return (least > 0).cast("int")
    if spec.op == "count_non_zero":
        return reduce(lambda a, b: a + b, [F.coalesce((c != 0).cast("int"), F.lit(0)) for c in cols])
    if spec.op == "sum":
        return total
    if spec.op == "mean":
        return F.try_divide(total.cast("double"), reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols]))
    if spec.op == "max":
        return most
    if spec.op == "min":
        return least
    if spec.op in ("difference", "ratio") and len(cols) == 2:
        return cols[0] - cols[1] if spec.op == "difference" else F.try_divide(cols[0].cast("double"), cols[1])
    raise RequestError(f"unknown row-wise derivation: {spec.op} of {len(cols)}")


def inferred_kind(op: str) -> Kind:
    return Kind.CATEGORICAL if op in ("any_on", "all_on") else Kind.COUNT if op == "count_non_zero" else Kind.MEASURE
