"""How a column wants to be drawn, kept as column metadata so that it follows the data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import Kind, Schema

#: Chart type and axis by kind.
DEFAULTS = {
    Kind.MEASURE: ("line", "left"), Kind.AVERAGE: ("line", "left"), Kind.COUNT: ("bar", "right"), Kind.CATEGORICAL: ("step", "right"), Kind.BINARY: ("step", "right"),
}


def hint(kind: Kind, **override) -> dict:
    """type, axis, and whether the column is an index or a series; keywords replace any of them."""
    chart, axis = DEFAULTS[kind]
    return {"type": chart, "axis": axis, "index": False, "series": False} | override


def with_hints(df: DataFrame, schema: Schema, overrides: dict[str, dict] | None = None) -> DataFrame:
    """``df`` with hints on the schema's columns; time is the index, components and the subject are series."""
    overrides = overrides or {}
    kinds = {m.name: m.kind for m in schema.measurements} | {d.name: d.resolved_kind for d in schema.derivations}
    series = {schema.subject, *(c for m in schema.measurements for c in m.components)}
    for name in df.columns:
        if name in kinds:
            df = df.withMetadata(name, {"chart": hint(kinds[name], **overrides.get(name, {}))})
        elif name == schema.time or name in series:
            df = df.withMetadata(name, {"chart": {"index": name == schema.time, "series": name in series}})
    return df


def hints_of(df: DataFrame) -> dict[str, dict]:
    return {f.name: f.metadata["chart"] for f in df.schema if "chart" in (f.metadata or {})}
