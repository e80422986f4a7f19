"""Opt-in traces and checks; nothing here runs on a query's hot path by itself."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Collector:
    """Sections with timings, notes and issues."""

    sections: dict[str, dict] = field(default_factory=dict)
    issues: list[tuple[str, str, str]] = field(default_factory=list)

    @contextmanager
    def section(self, name: str):
        began = time.perf_counter()
        entry = self.sections.setdefault(name, {"notes": []})
        try:
            yield entry
        finally:
            entry["us"] = int((time.perf_counter() - began) * 1e6)

    def note(self, name: str, text: str) -> None:
        self.sections.setdefault(name, {"notes": []})["notes"].append(text)

    def issue(self, level: str, name: str, text: str) -> None:
        self.issues.append((level, name, text))

    @property
    def ok(self) -> bool:
        return not any(level == "error" for level, _, _ in self.issues)


def traced(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows on the way, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def drift(before: int, after: int, collector: Collector, name: str) -> None:
    """Over 10 % more or fewer rows is a warning, over twice or under half an error."""
    if not before:
        return
    ratio = after / before
    if ratio > 2 or ratio < 0.5:
        collector.issue("error", name, f"{before} rows became {after}")
    elif abs(ratio - 1) > 0.1:
        collector.issue("warning", name, f"{before} rows became {after}")


def drift_of(before: DataFrame, after: DataFrame, collector: Collector, name: str) -> None:
    """``drift`` of two frames' rows; counts both, so it is for checks and not for a query's way."""
    drift(before.count(), after.count(), collector, name)
