"""Configuration of the matched-control pipeline, from TOML or keyword arguments."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import ConfigError
from ..functions.calendar import months_between, parse_month


@dataclass(frozen=True)
class Window:
    """Sum of a measure over months low..high relative to an anchor: ``reach`` (the subject's reach month),
    ``last`` (the month before the cohort's first reach, for everybody) or ``first`` (the study's first month)."""

    name: str
    low: int
    high: int
    anchor: str = "reach"

    @property
    def after(self) -> bool:
        """Reaches into or past the anchor month of treatment."""
        return self.anchor == "reach" and self.high >= 0


#: The windows used unless a configuration names others: L = before the cohort's first reach, PRE/TEST/POST = around own reach.
WINDOWS = (
    Window("L03M", -2, 0, "last"), Window("L06M", -5, 0, "last"), Window("L12M", -11, 0, "last"),
    Window("PRE01M", -1, -1), Window("PRE03M", -3, -1), Window("PRE06M", -6, -1), Window("PRE12M", -12, -1),
    Window("TEST01M", 0, 0), Window("POST02M", 1, 2), Window("POST04M", 1, 4), Window("POST06M", 1, 6),
)


@dataclass(frozen=True)
class DecileGroups:
    """Deciles merged into buckets: each group becomes its smallest decile; ``overrides`` are for single measures."""

    default: tuple[tuple[int, ...], ...] = ()
    overrides: dict[str, tuple[tuple[int, ...], ...]] = field(default_factory=dict)

    def validated(self) -> DecileGroups:
        for groups in (self.default, *self.overrides.values()):
            flat = [d for g in groups for d in g]
            if len(flat) != len(set(flat)):
                raise ConfigError("decile groups overlap")
        return self

    def mapping(self, measure: str) -> dict[int, int]:
        groups = self.overrides.get(measure, self.default)
        return {d: min(g) for g in groups for d in g}


@dataclass(frozen=True)
class VolumeGate:
    """Test and control may differ by ``distance`` merged deciles of ``column`` at most."""

    column: str
    distance: int = 0


@dataclass(frozen=True)
class Points:
    """The control nearest in ``column`` earns ``points``."""

    column: str
    points: float = 1.0


@dataclass(frozen=True)
class Autotune:
    """Relax volume gates, in this order and up to these distances, until ``target`` of the eligible tests have a candidate."""

    target: float = 0.0
    steps: tuple[VolumeGate, ...] = ()


@dataclass(frozen=True)
class Study:
    subject: str = "npi"
    month: str = "mth_cnt"
    measures: tuple[str, ...] = ("brx", "hrx", "grx")
    windows: tuple[Window, ...] = WINDOWS
    decile_windows: tuple[str, ...] = ("L03M", "L06M", "L12M")
    groups: DecileGroups = DecileGroups()
    signature: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    gates: tuple[str, ...] = ()
    propensity_gate: bool = False
    volume_gates: tuple[VolumeGate, ...] = ()
    autotune: Autotune | None = None
    points: tuple[Points, ...] = ()
    eligible: tuple[str, ...] = ()
    placebo: tuple[str, ...] = ()
    placebo_max: float = 1.0
    outcomes: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    min_reached: int = 1
    min_control: int = 1
    min_ratio: float = 0.0
    bins: int = 10
    binning: str = "equal_count"

    def validated(self) -> Study:
        """This study, or a ConfigError: nothing that follows treatment may feed matching or propensity."""
        by = {f"{m}_{w.name}": w for m in self.measures for w in self.windows}
        used = [*self.numeric, *[g.column for g in self.volume_gates], *[p.column for p in self.points]]
        if late := [c for c in used if c in by and by[c].after]:
            raise ConfigError(f"windows after treatment can't feed matching or propensity: {late}")
        if any(w.low > w.high for w in self.windows):
            raise ConfigError("a window ends before it begins")
        self.groups.validated()
        return self


@dataclass(frozen=True)
class Campaign:
    """Months are YYYY-MM; indexes are 1 for the study's first month."""

    start: str = "2024-01"
    months: int = 24
    reach_start: str = "2025-02"
    reach_months: int = 3
    reach_share: float = 0.5
    targets: int = 1000
    lift: float = 0.15
    ramp_months: int = 3
    control: float = 0.2

    @property
    def first_reach(self) -> int:
        return months_between(parse_month(self.start), parse_month(self.reach_start)) + 1

    def validated(self) -> Campaign:
        if self.first_reach < 1 or self.first_reach + self.reach_months - 1 > self.months:
            raise ConfigError("the reach window lies outside the study")
        return self


def parse(schema_text: str, campaign_text: str, study_text: str) -> tuple[dict, Campaign, Study]:
    """Generator schema, campaign and study from TOML."""
    schema, campaign, study = (tomllib.loads(t) for t in (schema_text, campaign_text, study_text))
    s = dict(study.get("study", study))
    if "windows" in s:
        s["windows"] = tuple(Window(**w) for w in s["windows"])
    if "volume_gates" in s:
        s["volume_gates"] = tuple(VolumeGate(**g) for g in s["volume_gates"])
    if "autotune" in s:
        s["autotune"] = Autotune(s["autotune"].get("target", 0.0), tuple(VolumeGate(**g) for g in s["autotune"].get("steps", ())))
    if "points" in s:
        s["points"] = tuple(Points(**p) for p in s["points"])
    if "groups" in s:
        g = s["groups"]
        tuples = lambda x: tuple(tuple(i) for i in x)
        s["groups"] = DecileGroups(tuples(g.get("default", ())), {k: tuples(v) for k, v in g.get("overrides", {}).items()})
    s = {k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}
    return schema, Campaign(**campaign.get("campaign", campaign)).validated(), Study(**s).validated()


def load(schema_path: str, campaign_path: str, study_path: str) -> tuple[dict, Campaign, Study]:
    """The three files of a run."""
    return parse(*(Path(p).read_text(encoding="utf-8") for p in (schema_path, campaign_path, study_path)))
