"""Plans and models without Spark."""

from datetime import datetime

import pytest

from tidewright.causal.config import Campaign, DecileGroups, Study, VolumeGate
from tidewright.diagnostics import Collector, drift
from tidewright.errors import ConfigError, RequestError, SchemaError
from tidewright.functions.calendar import months_between, parse_month
from tidewright.model import Derivation, Kind, Measurement, OverTime, Pointwise, ReportInterval, Schema, SignalPolicy, TimeRange, duration_ms
from tidewright.plans import planner


def unit(name, rate, up=None, ttl=60):
    return Measurement(name, policy=SignalPolicy.instant(ttl), sample_rate_ms=rate, upsample=up)


def test_durations():
    assert duration_ms("15m") == 900_000 and duration_ms("1h 30m") == 5_400_000 and duration_ms(2) == 2000
    for bad in ("", "soon", 0, "0s"):
        with pytest.raises(RequestError):
            duration_ms(bad)


def test_alignment():
    assert planner.align([]) is None
    same = planner.align([unit("a", 1000), unit("b", 1000)])
    assert same.rate_ms == 1000 and set(same.actions.values()) == {"signal_only"}
    up = planner.align([unit("a", 1000), unit("b", 5000, "forward_fill")])
    assert up.rate_ms == 1000 and up.actions == {"a": "signal_only", "b": "upsample"}
    down = planner.align([unit("a", 1000), unit("b", 5000)])
    assert down.rate_ms == 5000 and down.actions["a"] == "downsample"


def test_interval_and_join_choice():
    units = [unit("a", 1000, ttl=90), unit("b", 5000, ttl=30)]
    assert planner.grid_interval(units, None, 7000) == 7000 and planner.grid_interval(units, None, None) == 90_000
    assert planner.grid_interval(units, planner.align(units), 7000) == 5000
    assert planner.join_kind(units[0], 1000) == "equi" and planner.join_kind(units[0], 5000) == "asof"
    groups = planner.join_groups([unit("a", 1000), unit("b", 1000), unit("c", 2000)], {"a": "s", "b": "s", "c": "s"})
    assert [[m.name for m in g] for g in groups] == [["a", "b"], ["c"]]


def test_resample_paths():
    day = ReportInterval("days")
    assert planner.resample_path(86_400_000, day, False) == "passthrough" and planner.resample_path(60_000, day, False) == "aggregate"
    assert planner.resample_path(90_000_000, day, False) == "sparse" and planner.resample_path(90_000_000, day, True) == "upsample"
    with pytest.raises(RequestError):
        planner.resample_path(90_000_000, ReportInterval("days", strategy="dense"), False)
    assert ReportInterval("months", 2).approximate_ms == 60 * 86_400_000


def test_composition():
    a = ("s", "t", ("x",))
    assert planner.composition(a, a) == "stack" and planner.composition(a, ("s", "t", ())) == "reduce"
    assert planner.composition(a, ("s", None, ())) == "join" and planner.composition(a, ("o", "t", ("x",))) == "incompatible"


def test_schema_rules():
    m = unit("a", 1000)
    with pytest.raises(SchemaError):
        Schema("x", "s", "t", (Measurement("a"),)).validated()
    with pytest.raises(SchemaError):
        Schema("x", "s", "t", (Measurement("a", null_value="text"),)).validated(strict=False)
    with pytest.raises(SchemaError):
        Schema("x", "s", "t", (m,), (), (Derivation("d", Pointwise("sum", ("nope",))),)).validated()
    loop = (Derivation("d", OverTime("lag", "e")), Derivation("e", OverTime("lag", "d")))
    with pytest.raises(SchemaError):
        Schema("x", "s", "t", (m,), (), loop).validated()
    chain = Schema("x", "s", "t", (m, unit("b", 1000)), (), (Derivation("d", OverTime("lag", "e")), Derivation("e", OverTime("lag", "a")))).validated()
    assert chain.closure(["d"]) == ["a"] and [d.name for d in chain.derivation_order(["d"])] == ["e", "d"]
    other = Schema("y", "s", "t", (unit("a", 2000),))
    with pytest.raises(SchemaError):
        chain.combine(other)
    assert len(chain.combine(Schema("y", "s", "t", (unit("z", 1),))).measurements) == 3


def test_small_models():
    assert Kind.BINARY.default_aggregate == "any" and Kind.AVERAGE.default_aggregate == "mean"
    policy = SignalPolicy.from_json({"max_staleness": "5m", "windowing": {"sliding": {"duration": "1h", "min_samples": 3}}})
    assert (policy.kind, policy.ttl, policy.duration, policy.min_samples) == ("sliding", 300_000, 3_600_000, 3)
    now = datetime(2024, 1, 2)
    assert TimeRange.last(now, hours=24).start == datetime(2024, 1, 1)
    assert months_between(parse_month("2024-11"), parse_month("2025-02-01")) == 3
    with pytest.raises(RequestError):
        parse_month("2024-13")


def test_study_rules():
    assert Campaign().validated().first_reach == 14
    with pytest.raises(ConfigError):
        Campaign(reach_start="2025-12").validated()
    with pytest.raises(ConfigError):
        Study(volume_gates=(VolumeGate("brx_POST02M"),)).validated()
    with pytest.raises(ConfigError):
        Study(groups=DecileGroups(((1, 2), (2, 3)))).validated()


def test_diagnostics():
    c = Collector()
    with c.section("scan"):
        c.note("scan", "ok")
    drift(100, 105, c, "a")
    drift(100, 80, c, "b")
    assert c.ok and c.issues[0][0] == "warning"
    drift(100, 30, c, "c")
    assert not c.ok and c.sections["scan"]["notes"] == ["ok"]
