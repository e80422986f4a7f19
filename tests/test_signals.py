"""Grids, TTLs and fills on golden vectors, and the operators around them."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.errors import BindingError, RequestError
from tidewright.functions.expr import concat_key, java_pattern, truth
from tidewright.model import Derivation, Kind, Measurement, OverSubjects, Quality, ReportInterval, Schema, SignalPolicy, SubjectFilter, SubsetRequest, SyntheticSubject, TimeRange, TruthMapping
from tidewright.operators import align as A
from tidewright.operators import relational as R
from tidewright.plans.universe import Universe
from tidewright.sources.bind import BoundSource, Unpivot

START = datetime(2026, 1, 1, 9)
NOW = datetime(2026, 6, 1)


def at(minute):
    return START + timedelta(minutes=minute)


def sump(spark, minutes, values, ttl, null_value=None):
    m = Measurement("sump", policy=SignalPolicy.instant(ttl), sample_rate_ms=60_000, null_value=null_value)
    schema = Schema("pump", "station_id", "observation_time", (m,)).validated()
    df = spark.createDataFrame([("S", at(k), float(v)) for k, v in zip(minutes, values)], "station_id string, observation_time timestamp_ntz, sump double")
    return Universe.build(schema, [BoundSource.identity("pump", df, schema)], now=NOW)


@pytest.mark.parametrize(
    "minutes,values,ttl,null_value,want",
    [
        ([0, 1, 3, 4], [1, 1.5, 2, 2.5], 60, None, [1, 1.5, None, 2, 2.5]),
        ([0, 1, 3, 4], [1, 1.5, 2, 2.5], 60, 0.0, [1, 1.5, 0, 2, 2.5]),
        ([0, 3], [1, 4], 60, None, [1, None, None, 4]),
        ([0, 3], [1, 4], 90, None, [1, 1, None, 4]),
        ([0, 3], [1, 4], 121, None, [1, 1, 1, 4]),
        ([0, 5], [1, 6], 90, -1.0, [1, 1, -1, -1, -1, 6]),
        ([0, 1, 3, 4, 6, 7, 9], range(1, 8), 60, None, [1, 2, None, 3, 4, None, 5, 6, None, 7]),
    ],
)
def test_processed_grid(spark, minutes, values, ttl, null_value, want):
    u = sump(spark, minutes, values, ttl, null_value)
    req = SubsetRequest(("sump",), interval_ms=60_000, time_range=TimeRange(START - timedelta(hours=1), START + timedelta(hours=2)))
    rows = u.subset(req).df.orderBy("observation_time").collect()
    assert [r["sump"] for r in rows] == want and [r["observation_time"] for r in rows] == [at(k) for k in range(len(want))]
    assert u.subset_raw(req).df.count() == len(minutes)


def test_grid_ends_at_the_clock(spark):
    u = sump(spark, [0, 9], [1, 2], 60)
    u.now = at(4)
    assert u.subset(SubsetRequest(("sump",), interval_ms=60_000)).df.count() == 5


def pump_frame(spark):
    rows = [("Station_A", datetime(2023, 10, 27, 10) + timedelta(seconds=k), 10 + k / 10, 80.0, int(k % 2 == 0), int(k >= 10)) for k in range(20)]
    return spark.createDataFrame(rows, "station_id string, observation_time timestamp_ntz, sump double, fuel double, engine_1 int, engine_2 int")


SCHEMA = {
    "name": "pump_telemetry", "subject": "station_id", "time": "observation_time",
    "measurements": [{"name": "sump", "kind": "measure"}, {"name": "fuel", "kind": "measure"}, {"name": "engine_1", "kind": "categorical"}, {"name": "engine_2", "kind": "categorical"}],
    "derivations": [{"name": "any_engine_running", "computation": {"any_on": ["engine_1", "engine_2"]}, "kind": "categorical"}, {"name": "engines_running_count", "computation": {"count_non_zero": ["engine_1", "engine_2"]}}],
}


def test_json_schema_and_request(spark):
    schema = Schema.from_json(SCHEMA)
    assert schema.derivation("engines_running_count").resolved_kind is Kind.COUNT
    req = SubsetRequest.from_json({"measurements": ["sump", "fuel", "any_engine_running"], "qualities": [], "subject_filter": {"type": "Include", "values": ["Station_A"]}})
    u = Universe.build(schema, [BoundSource.identity("pump", pump_frame(spark), schema)], now=NOW)
    df = u.subset_raw(req).df
    assert df.columns == ["station_id", "observation_time", "sump", "fuel", "any_engine_running"] and df.count() == 20
    assert [r[-1] for r in df.orderBy("observation_time").collect()] == [int(k % 2 == 0 or k >= 10) for k in range(20)]
    with pytest.raises(RequestError):
        u.subset_raw(SubsetRequest(("missing",)))


def test_unpivot_and_component_crush(spark):
    m = Measurement("engine_status", Kind.BINARY, ("engine_id",), SignalPolicy.instant(60), 60_000)
    schema = Schema("p", "station_id", "observation_time", (m,)).validated()
    spec = Unpivot("engine_status", {"engine_1": {"engine_id": "1"}, "engine_2": {"engine_id": "2"}})
    src = BoundSource("pump", pump_frame(spark)).map("station_id", "station_id").map("observation_time", "observation_time").unpivot(spec)
    assert spec.run(pump_frame(spark), ["station_id"]).count() == 40
    rows = Universe.build(schema, [src], now=NOW).subset(SubsetRequest(("engine_status",), interval_ms=60_000)).df.collect()
    assert len(rows) == 1 and rows[0]["engine_status"] == 1 and "engine_id" not in rows[0].asDict()
    with pytest.raises(BindingError):
        Unpivot("x", {"nope": {"c": "1"}}).run(pump_frame(spark), ["station_id"])


def test_wide_groups_of_one_source(spark):
    ms = tuple(Measurement(n, policy=SignalPolicy.instant(60), sample_rate_ms=10_000) for n in ("sump", "fuel", "engine_1"))
    schema = Schema("p", "station_id", "observation_time", ms).validated()
    u = Universe.build(schema, [BoundSource.identity("pump", pump_frame(spark), schema)], now=NOW)
    out = u.subset(SubsetRequest(("sump", "fuel", "engine_1"), interval_ms=10_000))
    assert len(out.notes) == 1
    assert [(round(r.sump, 3), r.fuel, r.engine_1) for r in out.df.orderBy("observation_time").collect()] == [(10.45, 80.0, 0.5), (11.45, 80.0, 0.5)]


def test_asof_when_grids_differ(spark):
    u = sump(spark, [0, 7], [1, 2], 120)
    rows = u.subset(SubsetRequest(("sump",), interval_ms=300_000)).df.orderBy("observation_time").collect()
    assert [r["sump"] for r in rows] == [1.0, None]
    left = spark.createDataFrame([(1, at(3), "a"), (1, at(5), "b"), (2, at(5), "c")], "k int, t timestamp_ntz, tag string")
    right = spark.createDataFrame([(1, at(3), 7.0), (1, at(1), 6.0), (2, at(1), 9.0)], "k int, t timestamp_ntz, v double")
    got = {r["tag"]: r["v"] for r in A.asof(left, right, "t", ["k"], ["v"], 120_000).collect()}
    assert got == {"a": 7.0, "b": 7.0, "c": None}


def test_binary_with_component(spark):
    status = {("A", 100): ["on", "off", "off"], ("A", 200): ["on", "on"], ("B", 100): ["off"] * 3, ("B", 200): ["on", "off"]}
    rows = [(s, t, str(k + 1), x) for (s, t), xs in status.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "station string, timestamp long, engine string, engine_status string")
    m = Measurement("engine_status", Kind.BINARY, ("engine",), truth=TruthMapping(("on", "running", "1"), ("off", "stopped", "0")))
    schema = Schema("w", "station", "timestamp", (m,)).validated(strict=False)
    out = Universe.build(schema, [BoundSource.identity("w", df, schema)], now=NOW).subset_raw(SubsetRequest(("engine_status",))).df
    assert [r["engine_status"] for r in out.orderBy("station", "timestamp").collect()] == [1, 1, 0, 1]


def test_truth_mappings(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["yes", "no", "1", "0", "maybe"])], "k int, v string")
    got = lambda m: [r[0] for r in df.select("k", truth("v", m).alias("x")).orderBy("k").select("x").collect()]
    assert got(TruthMapping(("yes", "1"), ("no", "0"))) == [1, 0, 1, 0, None]
    assert got(TruthMapping(("yes",))) == [1, 0, 0, 0, 0]
    assert got(TruthMapping((1,), (0,))) == [None, None, 1, 0, None]


def test_report_months(spark):
    rows = [("A", datetime(2025, 1, d), v, f) for d, v, f in ((5, 1.0, 90.0), (10, 2.0, 80.0), (15, 3.0, 70.0), (20, 4.0, 60.0))]
    rows += [("B", datetime(2025, 1, 5), 10.0, 50.0), ("B", datetime(2025, 1, 25), 20.0, 40.0), ("A", datetime(2025, 2, 5), 100.0, 30.0), ("A", datetime(2025, 2, 10), 200.0, 20.0), ("B", datetime(2025, 2, 1), None, None)]
    df = spark.createDataFrame(rows, "station_id string, observation_time timestamp_ntz, sump double, fuel double")
    got = {(r.station_id, r.observation_time.month): r for r in A.report(df, ReportInterval("months"), "station_id", "observation_time", {"sump": "mean"}).collect()}
    a, b, c, d = got["A", 1], got["B", 1], got["A", 2], got["B", 2]
    assert (a.sump, a.sump_n, a.sump_min, a.sump_max) == (2.5, 4, 1.0, 4.0) and (b.sump, b.sump_n) == (15.0, 2)
    assert (c.sump, c.sump_n) == (150.0, 2) and (d.sump, d.sump_n, d.sump_null_count, d.sump_std) == (None, 0, 1, None)
    assert abs(a.sump_stderr - a.sump_std / 2) < 1e-12
    over = A.report(df, ReportInterval("months", overrides={"sump": "max"}, empty=-1.0), "station_id", "observation_time", {"sump": "mean"})
    assert {(r[0], r[1].month): r.sump for r in over.collect()} == {("A", 1): 4.0, ("B", 1): 20.0, ("A", 2): 200.0, ("B", 2): -1.0}


def test_qualities(spark):
    df = spark.createDataFrame([("Station_A", "North"), ("Station_B", "South"), ("Station_C", "North"), ("Station_D", None)], "station_id string, region string")
    schema = Schema("q", "station_id", "t", (), (Quality("region", "none"),)).validated()
    u = Universe.build(schema, [BoundSource.identity("q", df, schema)], now=NOW)
    count = lambda values: u.subset(SubsetRequest((), ("region",), quality_filter={"region": values})).df.count()
    assert (count(["South"]), count(["North", "South"]), count(["North"]), count(["none"])) == (1, 3, 2, 1)
    assert u.subset(SubsetRequest((), ("region",), subjects=SubjectFilter(exclude=("Station_A",)))).df.count() == 3


def test_grid_coverage(spark):
    base = datetime(2025, 12, 10)
    rows = [(w, z, base + timedelta(seconds=60 * k + s), float(k)) for w in "AB" for z in "123" for k in range(5) for s in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "w string, z string, t timestamp_ntz, v double")
    out = A.instant(df, "t", {"v": "mean"}, ["w", "z"], 60_000, 60_000)
    assert out.count() == 30 and out.where("v is null").count() == 0
    A.check_aligned(out, "t", ["w", "z"], 60_000)
    with pytest.raises(RequestError):
        A.check_aligned(df, "t", ["w", "z"], 60_000)


def test_fill_forward_crosses_no_key(spark):
    df = spark.createDataFrame([("A", at(0), 1.0), ("A", at(4), 2.0), ("B", at(2), 5.0)], "k string, t timestamp_ntz, v double")
    rows = {(r.k, r.t): r.v for r in A.resample(df, "t", "v", ["k"], 60_000, "interpolate").collect()}
    assert [rows["A", at(k)] for k in range(5)] == [1.0, 1.25, 1.5, 1.75, 2.0] and len(rows) == 6


def test_synthetic_subject_keeps_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "N"), ("b", 1, 4.0, "S")], "s string, t int, v double, region string")
    rows = {r.s: (r.v, r.region) for r in R.add_synthetic(df, [SyntheticSubject("all"), SyntheticSubject("{region} sum", "sum", group_by=("region",))], "s", "t", {"v": "mean"}).collect()}
    assert rows == {"a": (2.0, "N"), "b": (4.0, "S"), "all": (3.0, None), "N sum": (2.0, "N"), "S sum": (4.0, "S")}


def test_dedup_policies(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    value = lambda p: {r.k: r.v for r in R.dedup({"a": a, "b": b}, ["k"], p).collect()}
    assert value("first_wins") == {1: "a", 2: "b"} and value("last_wins") == {1: "b", 2: "b"}
    assert R.dedup({"a": a, "b": b}, ["k"], "keep_all").count() == 3
    with pytest.raises(BindingError):
        R.dedup({"a": a, "b": b}, ["k"], "error")


def test_concat_is_null_if_any_part_is(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(concat_key(["x", "y"], "-").to_column("k")).collect()] == [None, "a-b"]
    assert java_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


def test_stream_matches_batch(spark, tmp_path):
    from tidewright.streaming.live import tumbling_stream

    df = spark.createDataFrame([("a", at(k), float(k)) for k in range(30)], "s string, t timestamp_ntz, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = tumbling_stream(stream, "t", "v", ["s"], 600_000, 60_000, "sum").writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from live").collect()))
    assert got == sorted(map(tuple, tumbling_stream(df, "t", "v", ["s"], 600_000, 60_000, "sum").collect())) and len(got) == 3


def test_hints_expand_and_description(spark, tmp_path):
    from tidewright.functions.hints import hints_of, with_hints

    u = sump(spark, [0, 1], [1, 2], 60)
    df = with_hints(u.subset(SubsetRequest(("sump",), interval_ms=60_000)).df, u.schema, {"sump": {"axis": "right"}})
    assert hints_of(df)["sump"]["axis"] == "right" and hints_of(df)["observation_time"]["index"]
    assert u.describe() == {"sump": {"sources": ["pump"], "components": [], "crushed": []}}
    grid = spark.createDataFrame([("a", 1), ("a", 2)], "s string, t int")
    data = spark.createDataFrame([("a", 1, "x", 5.0), ("a", 2, "y", 6.0)], "s string, t int, c string, v double")
    assert sorted((r.t, r.c, r.v) for r in R.expand(grid, data, ["s", "t"], ["c"]).collect() if r.v) == [(1, "x", 5.0), (2, "y", 6.0)]
    assert R.expand(grid, data, ["s", "t"], ["c"]).count() == 4
    schema = Schema("q", "s", "t", (), (Quality("c"),)).validated()
    Universe.build(schema, [BoundSource.identity("q", data, schema)], now=NOW).write_qualities(str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_a_grid_is_exploded_in_many_tasks(spark):
    """Keys that lie in one small partition don't leave the whole grid to one task."""
    spans = spark.range(40).select(F.col("id").alias("k"), F.timestamp_micros(F.lit(0)).alias("low"), F.timestamp_micros(F.lit(99_000_000)).alias("high")).coalesce(1)
    out = A.explode_cells(spans, "low", "high", 1000, "t").withColumn("part", F.spark_partition_id())
    counts = out.groupBy("part").count().collect()
    assert sum(r["count"] for r in counts) == 4000 and len(counts) > 1


@pytest.mark.parametrize("op", ["rank", "quantile"])
def test_ranks_of_means_do_not_depend_on_the_split_of_rows(spark, op):
    """Many means are equal but for the last bit: a cell's values are added up in the order of their times."""
    values = {u: [((u * 7 + k * 13) % 10 + 1) / 10 for k in range(4)] for u in range(60)}
    rows = [(u, START + timedelta(minutes=k), v) for u, vs in values.items() for k, v in enumerate(vs)]
    schema = Schema("s", "user", "at", (Measurement("value", policy=SignalPolicy.instant("1h"), sample_rate_ms=3_600_000),), (), (Derivation("out", OverSubjects(op, "value", 4)),)).validated()
    df = spark.createDataFrame(rows, "user int, at timestamp_ntz, value double").repartition(7, F.xxhash64("user", "at"))
    got = {r["user"]: r["out"] for r in Universe.build(schema, [BoundSource.identity("s", df, schema)], now=NOW).subset(SubsetRequest(("out",), interval_ms=3_600_000)).df.collect()}
    means = {u: (((vs[0] + vs[1]) + vs[2]) + vs[3]) / 4 for u, vs in values.items()}
    assert len(set(means.values())) > len({round(m, 9) for m in means.values()})
    if op == "rank":
        assert got == {u: i + 1 for i, u in enumerate(sorted(means, key=lambda u: (-means[u], u)))}
    else:
        low, same = (lambda m: sum(x < m for x in means.values())), (lambda m: sum(x == m for x in means.values()))
        assert got == {u: math.ceil((low(m) + 1 + (same(m) - 1) / 2) / 60 * 4) for u, m in means.items()}
