"""Sources bound to a schema: renaming, computed columns, wide-to-long unpivots, reading and writing files."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BindingError
from ..functions.expr import KeyExpr
from ..model import Kind, Schema


@dataclass(frozen=True)
class Unpivot:
    """Columns of a wide source that become one measurement, each with its component values.

    ``inputs`` maps a source column to {component: value}.
    """

    measure: str
    inputs: dict[str, dict[str, str]]
    kind: Kind = Kind.MEASURE

    def components(self) -> list[str]:
        return list(dict.fromkeys(c for tags in self.inputs.values() for c in tags))

    def run(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Long rows (keys, components, measure); null values are dropped. One pass, whatever the width."""
        names = self.components()
        if missing := [c for c, tags in self.inputs.items() if set(tags) != set(names)]:
            raise BindingError(f"{self.measure}: {missing} lack some of the components {names}")
        if missing := [c for c in self.inputs if c not in df.columns]:
            raise BindingError(f"{self.measure}: the source lacks {missing}")
        cells = [F.struct(*[F.lit(tags[n]).alias(n) for n in names], F.col(c).alias(self.measure)) for c, tags in self.inputs.items()]
        long = df.select(*keys, F.explode(F.array(*cells)).alias("__c"))
        return long.select(*keys, *[f"__c.{n}" for n in names], f"__c.{self.measure}").where(F.col(self.measure).isNotNull())


@dataclass(frozen=True)
class BoundSource:
    """A frame with canonical names for its columns."""

    name: str
    df: DataFrame
    names: dict[str, str] = field(default_factory=dict)
    computed: dict[str, KeyExpr] = field(default_factory=dict)
    unpivots: tuple[Unpivot, ...] = ()
    provides: tuple[str, ...] = ()
    priority: int = 0

    @classmethod
    def identity(cls, name: str, df: DataFrame, schema: Schema) -> BoundSource:
        """Columns that carry the schema's own names."""
        wanted = [schema.subject, schema.time, *(m.name for m in schema.measurements), *(c for m in schema.measurements for c in m.components), *(q.name for q in schema.qualities)]
        return cls(name, df, {c: c for c in wanted if c in df.columns})

    def map(self, canonical: str, source: str) -> BoundSource:
        return replace(self, names=self.names | {canonical: source})

    def map_all(self, pairs: dict[str, str]) -> BoundSource:
        return replace(self, names=self.names | pairs)

    def map_expr(self, canonical: str, expr: KeyExpr) -> BoundSource:
        return replace(self, computed=self.computed | {canonical: expr})

    def unpivot(self, spec: Unpivot) -> BoundSource:
        return replace(self, unpivots=(*self.unpivots, spec))

    def with_priority(self, priority: int) -> BoundSource:
        return replace(self, priority=priority)

    def validated(self, schema: Schema) -> BoundSource:
        """This source, or a BindingError: it must have what it maps, and at least the subject."""
        if missing := [s for s in self.names.values() if s not in self.df.columns]:
            raise BindingError(f"source {self.name} lacks {missing}")
        for c, e in self.computed.items():
            if missing := [x for x in e.columns if x not in self.df.columns]:
                raise BindingError(f"source {self.name}: {c} needs {missing}")
        have = {*self.names, *self.computed}
        if schema.subject not in have:
            raise BindingError(f"source {self.name} has no {schema.subject}")
        for name in self.provides:
            made = {*have, *(u.measure for u in self.unpivots)}
            if name not in made:
                raise BindingError(f"source {self.name} promises {name} and does not bind it")
        return self

    def canonical(self) -> DataFrame:
        """Renamed and computed columns; the optimiser prunes what nobody asks for."""
        direct = [F.col(f"`{s}`").alias(c) for c, s in self.names.items() if c not in self.computed]
        extra = [c for u in self.unpivots for c in u.inputs if c not in self.names]
        return self.df.select(*direct, *[e.to_column(c) for c, e in self.computed.items()], *[F.col(f"`{c}`") for c in dict.fromkeys(extra)])


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table from Parquet, ORC, CSV (with header) or JSON; give text formats a schema."""
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), single_file: bool = False, mode: str = "overwrite") -> None:
    """Write a table; ``by`` partitions it, ``single_file`` is for small results only."""
    out = (df.coalesce(1) if single_file else df).write.mode(mode).format(kind)
    out = out.option("header", "true") if kind == "csv" else out
    (out.partitionBy(*by) if by else out).save(path)
