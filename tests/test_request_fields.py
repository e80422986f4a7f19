"""No field of a request is passed over in silence."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.errors import RequestError
from tidewright.model import Aggregate, Derivation, Kind, Measurement, Pointwise, Quality, ReportInterval, Schema, SignalPolicy, SubsetRequest, SyntheticSubject
from tidewright.plans.universe import Universe
from tidewright.sources.bind import BoundSource


def test_json_reads_every_field_and_refuses_others():
    req = SubsetRequest.from_json(
        {
            "NOTE": "x", "measurements": ["v"], "qualities": ["q"], "subject_filter": {"type": "Exclude", "values": ["a"]}, "quality_filter": {"quality": "q", "values": ["n"]}, "time_range": {"start": "2024-01-01", "end": None}, "interval": "15m",
            "component_filters": {"filters": {"color": {"levels": {"Include": ["red"]}}, "size": {"levels": "All"}}}, "aggregation_override": {"overrides": {"v": "max"}},
            "synthetic_subjects": [{"name_pattern": "{zone} x", "default_rule": "sum", "rules": {"v": "min"}, "group_by_quality": "zone", "group_by_component": None, "component_filters": {"color": "red"}}],
            "report_interval": {"bucket": {"type": "months", "count": 3}, "strategy": "native", "aggregation_override": {"v": "min"}, "empty_bucket": {"type": "value", "value": 0}},
        }
    )
    assert req.component_filter == {"color": {"include": ["red"]}, "size": {}} and req.aggregation == {"v": Aggregate.MAX} and req.interval_ms == 900_000
    assert req.synthetic == (SyntheticSubject("{zone} x", Aggregate.SUM, {"v": Aggregate.MIN}, ("zone",), None, {"color": "red"}),)
    assert (req.report.unit, req.report.count, req.report.strategy, req.report.overrides, req.report.empty) == ("months", 3, "native", {"v": Aggregate.MIN}, 0)
    assert SubsetRequest.from_json({"report_interval": {"bucket": {"weeks": 2}, "empty_bucket": {"type": "from_config"}}}).report.empty_from_config
    assert SubsetRequest.from_json({"report_interval": {"bucket": {"type": "fixed", "duration_ms": 5000}}}).report.approximate_ms == 5000
    for bad in ({"mesurements": []}, {"component_filters": {"c": {"levels": {"Only": []}}}}, {"subject_filter": {"type": "Some"}}, {"report_interval": {"bucket": {"days": 1}, "empty_bucket": {"type": "zero"}}}):
        with pytest.raises(RequestError):
            SubsetRequest.from_json(bad)


def test_report_keeps_synthetic_rows(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 3.0)]
    df = spark.createDataFrame(rows, "who string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    schema = Schema("s", "who", "t", (Measurement("v", policy=SignalPolicy.instant("1h"), sample_rate_ms=3_600_000),)).validated()
    universe = Universe.build(schema, [BoundSource.identity("s", df, schema)])
    got = universe.subset(SubsetRequest(("v",), interval_ms=3_600_000, report=ReportInterval("days"), synthetic=(SyntheticSubject("all", Aggregate.SUM),))).df
    assert {r["who"]: r["v"] for r in got.collect()} == {"a": 1.0, "b": 3.0, "all": 4.0}


def shirts(spark):
    rows = [("a", "red", 1, 1.0), ("a", "blue", 1, 2.0), ("b", "red", 1, 4.0), ("b", "blue", 2, 8.0), ("c", "red", 2, 16.0)]
    df = spark.createDataFrame(rows, "who string, color string, d int, sold double").withColumn("t", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)))
    zones = spark.createDataFrame([("a", "north"), ("b", "south"), ("c", "north")], "who string, zone string")
    day = 86_400_000
    schema = Schema("s", "who", "t", (Measurement("sold", Kind.COUNT, ("color",), SignalPolicy.instant("24h"), day), Measurement("other", policy=SignalPolicy.instant("24h"), sample_rate_ms=day)), (Quality("zone"),)).validated()
    plain = df.groupBy("who", "t").agg(F.sum("sold").alias("other"))
    sources = [BoundSource.identity("sold", df, schema), BoundSource.identity("other", plain, schema), BoundSource.identity("zones", zones, schema)]
    return Universe.build(schema, sources, now=datetime(2030, 1, 1))


def ask(spark, synthetic, report=None):
    df = shirts(spark).subset(SubsetRequest(("sold", "other"), interval_ms=86_400_000, synthetic=(synthetic,), report=report)).df
    return {(r["who"], r["t"].day): (r["sold"], r["other"]) for r in df.collect() if r["who"] not in ("a", "b", "c")}


def test_synthetic_subjects_by_component_and_quality(spark):
    assert ask(spark, SyntheticSubject("{color} total", Aggregate.SUM, by_component="color")) == {("red total", 1): (5.0, None), ("red total", 2): (16.0, None), ("blue total", 1): (2.0, None), ("blue total", 2): (8.0, None)}
    assert ask(spark, SyntheticSubject("{quality}", Aggregate.SUM, where={"color": "red"}, group_by=("zone",))) == {("north", 1): (1.0, None), ("north", 2): (16.0, None), ("south", 1): (4.0, None), ("south", 2): (None, None)}
    assert ask(spark, SyntheticSubject("all", Aggregate.MAX, by_component="color"), ReportInterval("months")) == {("all_red", 1): (16.0, None), ("all_blue", 1): (8.0, None)}
    assert ask(spark, SyntheticSubject("zone {zone}", Aggregate.SUM, group_by=("zone",)))["zone north", 2] == (16.0, 16.0)
    with pytest.raises(RequestError):
        ask(spark, SyntheticSubject("x", where={"size": "l"}))


def test_report_of_derivations_alone_is_not_bucketed(spark):
    rows = [("a", k, float(k)) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "who string, d int, v double").withColumn("t", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)))
    schema = Schema("s", "who", "t", (Measurement("v", policy=SignalPolicy.instant("24h"), sample_rate_ms=86_400_000),), (), (Derivation("twice", Pointwise("sum", ("v", "v"))),)).validated()
    got = Universe.build(schema, [BoundSource.identity("s", df, schema)], now=datetime(2030, 1, 1)).subset(SubsetRequest(("twice",), interval_ms=86_400_000, report=ReportInterval("months")))
    assert sorted(r["twice"] for r in got.df.collect()) == [2.0, 4.0, 6.0] and "not put into buckets" in got.notes[-1]
