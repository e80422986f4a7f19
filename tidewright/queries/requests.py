"""Queries of bindings, requests, alignment, sinks and plans: what users do through ``Universe`` and its neighbours."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diagnostics import Collector, drift, drift_of, traced
from ..errors import EngineError
from ..functions import expr as X
from ..functions.calendar import floor_to
from ..model import Aggregate, Downsample, Kind, Measurement, Quality, ReportInterval, Schema, SignalPolicy, SubjectFilter, SubsetRequest, SyntheticSubject, Temporality, TimeRange, Upsample, duration_ms
from ..operators import align as A
from ..operators import relational as R
from ..operators.materialize import shared_dir
from ..plans import planner
from ..plans.universe import Universe
from ..sources import bind as B
from .timeseries import DAY, HOUR, NOW, customer_universe, daily, event_schema, event_universe, grid_sql, rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


# -- policies and alignment ------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_suppkey, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS t, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2),
          p AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 7 DAY)) AS t FROM c),
          g AS (SELECT l_suppkey, p.t, q, e FROM (SELECT DISTINCT l_suppkey FROM c) u CROSS JOIN p LEFT JOIN c USING (l_suppkey, t))
          SELECT l_suppkey, t AS l_shipdate, round(last_value(q IGNORE NULLS) OVER w, 6) AS l_quantity, round(last_value(e IGNORE NULLS) OVER w, 6) AS l_extendedprice FROM g
          WINDOW w AS (PARTITION BY l_suppkey ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def instant_wide_columns(spark, sf):
    """Two measurements of one source: one scan, one aggregation, one grid, one join."""
    ms = tuple(Measurement(n, policy=SignalPolicy.instant("14d"), sample_rate_ms=7 * DAY) for n in ("l_quantity", "l_extendedprice"))
    schema = Schema("parts", "l_suppkey", "l_shipdate", ms).validated()
    u = Universe.build(schema, [B.BoundSource.identity("lineitem", table(spark, sf, "lineitem"), schema)], now=NOW)
    return rounded(u.subset(SubsetRequest(("l_quantity", "l_extendedprice"), interval_ms=7 * DAY)).df)


@query(grid_sql("6 HOUR", 2) + " SELECT user_id, t AS ts, round(v, 6) AS value FROM d")
def instant_string_time(spark, sf):
    """Times come as text, to the minute."""
    ev = table(spark, sf, "events").withColumn("ts", F.date_format("ts", "yyyy/MM/dd HH:mm"))
    m = Measurement("value", policy=SignalPolicy.instant(18 * 3600, "%Y/%m/%d %H:%M"), sample_rate_ms=6 * HOUR)
    schema = Schema("events", "user_id", "ts", (m,)).validated()
    u = Universe.build(schema, [B.BoundSource.identity("events", ev, schema)], now=NOW)
    return rounded(u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR)).df)


@query(grid_sql("6 HOUR", 2) + " SELECT user_id, t AS ts, round(v, 6) AS value FROM d WHERE t <= TIMESTAMP '2024-01-15 03:00:00'")
def grid_ends_at_clock(spark, sf):
    schema = event_schema()
    u = Universe.build(schema, [B.BoundSource.identity("events", table(spark, sf, "events"), schema)], now=datetime(2024, 1, 15, 3))
    return rounded(u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR)).df)


def two_rates(spark: SparkSession, sf: str, upsample: Upsample | None) -> DataFrame:
    """Purchases every six hours, views every day, from two sources, on the rate that they share."""
    ms = (
        Measurement("purchase", policy=SignalPolicy.instant("6h"), sample_rate_ms=6 * HOUR),
        Measurement("view", policy=SignalPolicy.instant("24h"), sample_rate_ms=DAY, upsample=upsample),
    )
    schema = Schema("e", "user_id", "ts", ms).validated()
    ev = table(spark, sf, "events")
    sources = [B.BoundSource(k, ev.where(F.col("event_type") == k), {"user_id": "user_id", "ts": "ts", k: "value"}) for k in ("purchase", "view")]
    return rounded(Universe.build(schema, sources, now=NOW).ensure_aligned().subset(SubsetRequest(("purchase", "view"))).df)


_TWO = """WITH s AS (SELECT * FROM events WHERE event_type IN ('purchase', 'view')),
    p6 AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS t, avg(value) AS v FROM s WHERE event_type = 'purchase' GROUP BY 1, 2),
    v1 AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM s WHERE event_type = 'view' GROUP BY 1, 2),
    u AS (SELECT DISTINCT user_id FROM s), """


@query(_TWO + """p AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, t) AS t, avg(v) AS v FROM p6 GROUP BY 1, 2),
    g AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 DAY, min(ts)), max(ts), INTERVAL 1 DAY)) AS t FROM s)
    SELECT u.user_id AS user_id, g.t AS ts, round(p.v, 6) AS purchase, round(v1.v, 6) AS view FROM u CROSS JOIN g LEFT JOIN p ON p.user_id = u.user_id AND p.t = g.t LEFT JOIN v1 ON v1.user_id = u.user_id AND v1.t = g.t""")
def aligned_to_the_slowest(spark, sf):
    """Nothing may be made up, so the faster signal is downsampled."""
    return two_rates(spark, sf, None)


@query(_TWO + """f AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 6 HOUR)) AS t FROM v1),
    w AS (SELECT x.user_id, f.t, last_value(v1.v IGNORE NULLS) OVER (PARTITION BY x.user_id ORDER BY f.t) AS v FROM (SELECT DISTINCT user_id FROM v1) x CROSS JOIN f LEFT JOIN v1 ON v1.user_id = x.user_id AND v1.t = f.t),
    g AS (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, min(ts)), max(ts), INTERVAL 6 HOUR)) AS t FROM s)
    SELECT u.user_id AS user_id, g.t AS ts, round(p6.v, 6) AS purchase, round(w.v, 6) AS view FROM u CROSS JOIN g LEFT JOIN p6 ON p6.user_id = u.user_id AND p6.t = g.t LEFT JOIN w ON w.user_id = u.user_id AND w.t = g.t""")
def aligned_to_the_fastest(spark, sf):
    """The slower signal may be filled forward, so the faster rate is shared."""
    return two_rates(spark, sf, Upsample.FORWARD_FILL)


@query("""WITH a AS (SELECT l_suppkey, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS t, avg(l_quantity) AS q, sum(l_discount) AS d FROM lineitem GROUP BY 1, 2),
          b AS (SELECT l_suppkey, time_bucket(INTERVAL 14 DAY, t, TIMESTAMP '1970-01-01') AS t, max(q) AS q, avg(q) AS m FROM a GROUP BY 1, 2),
          x AS (SELECT l_suppkey, time_bucket(INTERVAL 14 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS t, avg(l_tax) AS x FROM lineitem GROUP BY 1, 2),
          e AS (SELECT l_suppkey, time_bucket(INTERVAL 14 DAY, t, TIMESTAMP '1970-01-01') AS t, avg(p) AS p FROM (SELECT l_suppkey, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS t, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2),
          g AS (SELECT unnest(generate_series(time_bucket(INTERVAL 14 DAY, min(l_shipdate), TIMESTAMP '1970-01-01'), max(l_shipdate), INTERVAL 14 DAY)) AS t FROM lineitem)
          SELECT u.l_suppkey AS l_suppkey, g.t AS l_shipdate, round(b.q, 6) AS l_quantity, round(e.p, 6) AS l_extendedprice, round(x.x, 6) AS l_tax FROM (SELECT DISTINCT l_suppkey FROM lineitem) u CROSS JOIN g
          LEFT JOIN b ON b.l_suppkey = u.l_suppkey AND b.t = g.t LEFT JOIN e ON e.l_suppkey = u.l_suppkey AND e.t = g.t LEFT JOIN x ON x.l_suppkey = u.l_suppkey AND x.t = g.t""")
def aligned_wide_columns(spark, sf):
    """Two weekly columns of one source go down together, each by its own strategy, to the third one's fortnights."""
    ms = (
        Measurement("l_quantity", policy=SignalPolicy.instant("7d"), sample_rate_ms=7 * DAY, downsample=Downsample.MAX), Measurement("l_extendedprice", policy=SignalPolicy.instant("7d"), sample_rate_ms=7 * DAY),
        Measurement("l_tax", policy=SignalPolicy.instant("14d"), sample_rate_ms=14 * DAY),
    )
    schema = Schema("parts", "l_suppkey", "l_shipdate", ms).validated()
    u = Universe.build(schema, [B.BoundSource.identity("lineitem", table(spark, sf, "lineitem"), schema)], now=NOW).ensure_aligned()
    return rounded(u.subset(SubsetRequest(("l_quantity", "l_extendedprice", "l_tax"))).df)


@query("""WITH p AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2 HAVING t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20'),
          v AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2 HAVING t >= TIMESTAMP '2024-01-10' AND t <= TIMESTAMP '2024-01-20'),
          u AS (SELECT user_id FROM p UNION SELECT user_id FROM v),
          b AS (SELECT least((SELECT min(t) FROM p), (SELECT min(t) FROM v)) AS lo, greatest(least((SELECT max(t) FROM p), TIMESTAMP '2024-01-15 12:00:00'), (SELECT max(t) FROM v)) AS hi),
          g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t FROM b)
          SELECT u.user_id AS user_id, g.t AS ts, round(p.v, 6) AS purchase, round(v.v, 6) AS plan FROM u CROSS JOIN g LEFT JOIN p ON p.user_id = u.user_id AND p.t = g.t LEFT JOIN v ON v.user_id = u.user_id AND v.t = g.t""")
def forecast_bounds(spark, sf):
    """A forecast keeps its range beyond the clock, and its row at the end of the request's range."""
    ev = table(spark, sf, "events").groupBy("user_id", "event_type", floor_to("ts", DAY).alias("ts")).agg(F.avg("value").alias("value"))
    ms = (
        Measurement("purchase", policy=SignalPolicy.instant("24h"), sample_rate_ms=DAY),
        Measurement("plan", policy=SignalPolicy.instant("24h"), sample_rate_ms=DAY, temporality=Temporality.FORECAST),
    )
    schema = Schema("e", "user_id", "ts", ms).validated()
    sources = [B.BoundSource(k, ev.where(F.col("event_type") == t), {"user_id": "user_id", "ts": "ts", k: "value"}) for k, t in (("purchase", "purchase"), ("plan", "view"))]
    u = Universe.build(schema, sources, now=datetime(2024, 1, 15, 12))
    return rounded(u.subset(SubsetRequest(("purchase", "plan"), time_range=TimeRange("2024-01-10", "2024-01-20"), interval_ms=DAY)).df)


@query("""WITH s AS (SELECT user_id, date_trunc('day', min(ts))::TIMESTAMP AS lo, date_trunc('day', max(ts))::TIMESTAMP AS hi FROM events GROUP BY 1),
          b AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t FROM s), r AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS t, sum(value) AS v, count(value) AS n FROM events GROUP BY 1, 2)
          SELECT b.user_id AS user_id, b.t AS ts, round(coalesce(v, 0), 6) AS value, coalesce(n, 0) AS value_n FROM b LEFT JOIN r ON r.user_id = b.user_id AND r.t = b.t""")
def report_empty_buckets(spark, sf):
    """Days without an event are there, with the value that the request says."""
    out = A.report(table(spark, sf, "events"), ReportInterval("days", empty=0.0), "user_id", "ts", {"value": "sum"})
    return rounded(out.select("user_id", "ts", "value", "value_n"))


@query("""WITH s AS (SELECT user_id, date_trunc('week', min(ts))::TIMESTAMP AS lo, date_trunc('week', max(ts))::TIMESTAMP AS hi FROM events WHERE event_type = 'signup' GROUP BY 1),
          b AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS t FROM s), r AS (SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS t, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
          SELECT b.user_id AS user_id, b.t AS ts, coalesce(v, -1) AS value FROM b LEFT JOIN r ON r.user_id = b.user_id AND r.t = b.t""")
def report_empty_from_config(spark, sf):
    """An empty week holds the measurement's own null value."""
    ev = table(spark, sf, "events").where("event_type = 'signup'")
    out = A.report(ev, ReportInterval("weeks", empty_from_config=True, stats=False), "user_id", "ts", {"value": "max"}, {"value": -1.0})
    return out.select("user_id", "ts", "value")


_CHECKS = [("aligned", 6 * HOUR, 2 * DAY), ("another rate", 4 * HOUR, 2 * DAY), ("another ttl", 6 * HOUR, DAY)]


@query("SELECT * FROM (VALUES ('aligned', true), ('another rate', false), ('another ttl', false)) v(what, passed)")
def policy_checks(spark, sf):
    """Shape, grid and TTL of an aligned signal, and two wrong expectations of it."""
    ev = table(spark, sf, "events").select("user_id", "ts", "value")
    aligned = A.instant(ev, "ts", {"value": "mean"}, ["user_id"], 6 * HOUR, 2 * DAY)
    out = []
    for what, rate, ttl in _CHECKS:
        try:
            A.check_policy(ev, aligned, "ts", "value", ["user_id"], rate, ttl)
            out.append((what, True))
        except EngineError:
            out.append((what, False))
    return spark.createDataFrame(out, "what string, passed boolean")


# -- components and synthetic subjects -------------------------------------------------------------------------


def typed_universe(spark: SparkSession, sf: str, **more) -> Universe:
    m = Measurement("value", components=("event_type",), policy=SignalPolicy.instant("24h"), sample_rate_ms=DAY, **more)
    schema = Schema("events", "user_id", "ts", (m,)).validated()
    return Universe.build(schema, [B.BoundSource.identity("events", table(spark, sf, "events"), schema)], now=NOW)


_TYPED = """WITH c AS (SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2, 3),
    p AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM c),
    b AS (SELECT user_id, t, avg(v) AS v, max(v) AS most FROM c GROUP BY 1, 2),
    g AS (SELECT u.user_id, p.t, v, most FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN p LEFT JOIN b ON b.user_id = u.user_id AND b.t = p.t)"""


@query(_TYPED + """ SELECT user_id::VARCHAR AS user_id, t AS ts, round(v, 6) AS value FROM g
    UNION ALL SELECT x.event_type || ' total', p.t, round(sum(c.v), 6) FROM (SELECT DISTINCT event_type FROM c) x CROSS JOIN p LEFT JOIN c ON c.event_type = x.event_type AND c.t = p.t GROUP BY 1, 2""")
def synthetic_by_component(spark, sf):
    """A subject for each event type, beside the users whose types are reduced."""
    req = SubsetRequest(("value",), interval_ms=DAY, synthetic=(SyntheticSubject("{component} total", Aggregate.SUM, by_component="event_type"),))
    return rounded(typed_universe(spark, sf).subset(req).df)


@query(_TYPED + """ SELECT user_id::VARCHAR AS user_id, t AS ts, round(v, 6) AS value FROM g
    UNION ALL SELECT 'purchases', p.t, round(max(c.v), 6) FROM p LEFT JOIN c ON c.event_type = 'purchase' AND c.t = p.t GROUP BY 1, 2""")
def synthetic_where_component(spark, sf):
    req = SubsetRequest(("value",), interval_ms=DAY, synthetic=(SyntheticSubject("purchases", Aggregate.MEAN, {"value": Aggregate.MAX}, where={"event_type": "purchase"}),))
    return rounded(typed_universe(spark, sf).subset(req).df)


@query(_TYPED + " SELECT user_id, t AS ts, round(most, 6) AS value FROM g")
def aggregation_override(spark, sf):
    """The request says how types are reduced, not the measurement."""
    return rounded(typed_universe(spark, sf).subset(SubsetRequest(("value",), interval_ms=DAY, aggregation={"value": Aggregate.MAX})).df)


@query("""WITH c AS (SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM events WHERE event_type IN ('purchase', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND user_id NOT IN (1, 2) GROUP BY 1, 2, 3),
          p AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM c), b AS (SELECT user_id, t, max(v) AS v FROM c GROUP BY 1, 2)
          SELECT u.user_id AS user_id, p.t AS ts, round(v, 6) AS value FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN p LEFT JOIN b ON b.user_id = u.user_id AND b.t = p.t""")
def request_json(spark, sf):
    """A whole request from JSON: subjects, times, levels, override and interval."""
    req = SubsetRequest.from_json("""{"measurements": ["value"], "interval": "1d", "subject_filter": {"type": "Exclude", "values": [1, 2]}, "time_range": {"start": "2024-01-05", "end": "2024-01-12"},
        "component_filters": {"filters": {"event_type": {"levels": {"Include": ["purchase", "view"]}}}}, "aggregation_override": {"overrides": {"value": "max"}}}""")
    return rounded(typed_universe(spark, sf).subset(req).df)


@query("""WITH r AS (SELECT user_id, date_trunc('month', t)::TIMESTAMP AS m, max(v) AS value, count(v) AS n, count(*) FILTER (v IS NULL) AS gone FROM (""" + grid_sql("6 HOUR", 2) + """ SELECT user_id, t, v FROM d) GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS user_id, m AS ts, round(value, 6) AS value, n AS value_n, gone AS value_null_count FROM r UNION ALL SELECT 'fleet', m, round(sum(value), 6), NULL, NULL FROM r GROUP BY m""")
def report_with_synthetic(spark, sf):
    """Synthetic rows are made of the report's rows, and come with it; from JSON."""
    req = SubsetRequest.from_json({"measurements": ["value"], "interval": "6h", "synthetic_subjects": [{"name_pattern": "fleet", "default_rule": "sum"}], "report_interval": {"bucket": {"type": "months", "count": 1}, "aggregation_override": {"value": "max"}}})
    out = event_universe(spark, sf, event_schema()).subset(req).df
    return rounded(out.select("user_id", "ts", "value", "value_n", "value_null_count"))


@query("""WITH g AS (SELECT u.user_id, d.t FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(time_bucket(INTERVAL 1 DAY, min(ts)), max(ts), INTERVAL 1 DAY)) AS t FROM events) d),
          c AS (SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2, 3), s AS (SELECT DISTINCT user_id, event_type FROM c)
          SELECT g.user_id AS user_id, s.event_type AS event_type, g.t AS ts, round(c.v, 6) AS value FROM g JOIN s ON s.user_id = g.user_id LEFT JOIN c ON c.user_id = g.user_id AND c.event_type = s.event_type AND c.t = g.t""")
def component_series(spark, sf):
    """Types are kept: a series for each that a user has, on the whole grid."""
    cells = A.tumbling(table(spark, sf, "events"), "ts", "value", ["user_id", "event_type"], DAY, Aggregate.MEAN)
    grid = A.dense(daily(spark, sf), "ts", ["user_id"], DAY).select("user_id", "ts")
    return rounded(R.expand(grid, cells, ["user_id", "ts"], ["event_type"]))


# -- sources and sinks -----------------------------------------------------------------------------------------


@query("SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS ts, event_type || '/' || user_id::VARCHAR AS series, round(avg(value), 6) AS value FROM events GROUP BY 1, 2, 3")
def bound_expressions(spark, sf):
    """Time and component are computed by the binding."""
    ev = table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "dd.MM.yyyy HH:mm").alias("clock"), "value")
    source = B.BoundSource("events", ev).map_all({"user_id": "user_id", "value": "value"}).map_expr("ts", X.parse_datetime("clock", "%d.%m.%Y %H:%M")).map_expr("series", X.concat_key(["event_type", "user_id"], "/"))
    schema = Schema("events", "user_id", "ts", (Measurement("value", components=("series",), policy=SignalPolicy.instant(60), sample_rate_ms=60_000),)).validated()
    u = Universe.build(schema, [source], now=NOW)
    rows = u.measures["value"][0].df
    return rounded(R.crush(rows, ["user_id", "ts", "series"], {"value": "mean"}).select("user_id", "ts", "series", "value"))


@query("""WITH a AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2)
          SELECT user_id, ts, round(coalesce(a.v, b.v), 6) AS value FROM b LEFT JOIN a USING (user_id, ts)""")
def source_priority(spark, sf):
    """Two sources give a measurement; at a time that both have, the one of higher priority counts. What else they hold is not provided."""
    ev = table(spark, sf, "events")
    day = lambda df: df.groupBy("user_id", floor_to("ts", DAY).alias("ts")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    schema = Schema("e", "user_id", "ts", tuple(Measurement(n, policy=SignalPolicy.instant("24h"), sample_rate_ms=DAY) for n in ("value", "n"))).validated()
    bind = lambda name, df, k: B.BoundSource(name, day(df), {c: c for c in ("user_id", "ts", "value", "n")}, provides=("value",)).with_priority(k)
    u = Universe.build(schema, [bind("all", ev, 2), bind("purchases", ev.where("event_type = 'purchase'"), 1)], now=NOW, overlap="first_wins")
    if "n" in u.measures:
        raise AssertionError("a source gives what it does not provide")
    return rounded(u.subset_raw(SubsetRequest(("value",))).df)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def quality_priority(spark, sf):
    """A quality comes from the first source by priority that has a value."""
    cu = table(spark, sf, "customer")
    first = cu.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    schema = Schema("c", "c_custkey", "t", (), (Quality("c_mktsegment"),)).validated()
    sources = [B.BoundSource.identity("b", cu.select("c_custkey", F.lit("second").alias("c_mktsegment")), schema).with_priority(2), B.BoundSource.identity("a", first, schema).with_priority(1)]
    return Universe.build(schema, sources, now=NOW).subset(SubsetRequest((), ("c_mktsegment",))).df


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-20'")
def time_range_last_days(spark, sf):
    return R.filter_time(table(spark, sf, "events"), "ts", TimeRange.last(datetime(2024, 1, 20), days=3)).select("event_id", "user_id", "event_type")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders", "csv_round_trip")
def csv_round_trip(spark, sf):
    """Written as CSV with a header, and read again by a schema."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    B.write(df, path := _folder(spark), "csv")
    return B.read(spark, path, "csv", "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "json_round_trip")
def json_round_trip(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    B.write(df, path := _folder(spark), "json")
    return B.read(spark, path, "json", "o_orderkey long, o_custkey long, o_totalprice double")


@query("SELECT c_custkey AS o_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def qualities_sink(spark, sf):
    """All qualities as one Parquet table."""
    customer_universe(spark, sf).write_qualities(path := _folder(spark))
    return B.read(spark, path)


# -- plans and diagnostics -------------------------------------------------------------------------------------


def _unit(name: str, rate: int, up: Upsample | None = None, ttl: int = 60, **more) -> Measurement:
    return Measurement(name, policy=SignalPolicy.instant(ttl), sample_rate_ms=rate, upsample=up, **more)


@query("""SELECT * FROM (VALUES ('same', 'a', 1000, 'signal_only'), ('same', 'b', 1000, 'signal_only'), ('fastest', 'a', 1000, 'signal_only'), ('fastest', 'b', 1000, 'upsample'),
          ('slowest', 'a', 5000, 'downsample'), ('slowest', 'b', 5000, 'signal_only'), ('no rate', 'a', 1000, 'signal_only'), ('no rate', 'b', 1000, 'pass_through')) v(what, unit, rate_ms, action)""")
def plan_alignment(spark, sf):
    cases = {"same": [_unit("a", 1000), _unit("b", 1000)], "fastest": [_unit("a", 1000), _unit("b", 5000, Upsample.INTERPOLATE)], "slowest": [_unit("a", 1000), _unit("b", 5000)], "no rate": [_unit("a", 1000), Measurement("b")]}
    rows = [(what, unit, plan.rate_ms, action) for what, units in cases.items() for plan in [planner.align(units)] for unit, action in plan.actions.items()]
    return spark.createDataFrame(rows, "what string, unit string, rate_ms int, action string")


@query("""SELECT * FROM (VALUES ('the rate of alignment', 5000, 'equi', 'asof'), ('the request', 7000, 'asof', 'asof'), ('the longest ttl', 90000, 'asof', 'asof'), ('its own rate', 1000, 'asof', 'equi')) v(what, interval_ms, join_b, join_a)""")
def plan_grid_interval(spark, sf):
    units = [_unit("a", 1000, ttl=90), _unit("b", 5000, ttl=30)]
    steps = {"the rate of alignment": planner.grid_interval(units, planner.align(units), 7000), "the request": planner.grid_interval(units, None, 7000), "the longest ttl": planner.grid_interval(units, None, None), "its own rate": 1000}
    rows = [(what, step, planner.join_kind(units[1], step), planner.join_kind(units[0], step)) for what, step in steps.items()]
    return spark.createDataFrame(rows, "what string, interval_ms int, join_b string, join_a string")


@query("SELECT * FROM (VALUES (0, 'a'), (0, 'b'), (1, 'c'), (2, 'd'), (3, 'e'), (4, 'f')) v(part, unit)")
def plan_join_groups(spark, sf):
    """Units of one source, rate, policy and set of components are one scan, one aggregation and one join."""
    units = [_unit("a", 1000), _unit("b", 1000), _unit("c", 2000), _unit("d", 1000, components=("x",)), _unit("e", 1000, ttl=90), _unit("f", 1000)]
    groups = planner.join_groups(units, {"a": "s", "b": "s", "c": "s", "d": "s", "e": "s", "f": "other"})
    return spark.createDataFrame([(k, m.name) for k, g in enumerate(groups) for m in g], "part int, unit string")


@query("""SELECT * FROM (VALUES (60000, 'auto', false, 'aggregate'), (86400000, 'auto', false, 'passthrough'), (90000000, 'auto', false, 'sparse'), (90000000, 'auto', true, 'upsample'),
          (90000000, 'sparse', true, 'sparse'), (90000000, 'dense', false, 'error')) v(rate_ms, strategy, upsample, path)""")
def plan_resampling(spark, sf):
    rows = []
    for rate, strategy, up in ((60_000, "auto", False), (DAY, "auto", False), (90_000_000, "auto", False), (90_000_000, "auto", True), (90_000_000, "sparse", True), (90_000_000, "dense", False)):
        try:
            path = planner.resample_path(rate, ReportInterval("days", strategy=strategy), up)
        except EngineError:
            path = "error"
        rows.append((rate, strategy, up, path))
    return spark.createDataFrame(rows, "rate_ms int, strategy string, upsample boolean, path string")


@query("SELECT * FROM (VALUES ('months', 2, 5184000000), ('weeks', 1, 604800000), ('days', 3, 259200000), ('hours', 6, 21600000), ('fixed', 1500, 1500)) v(unit, n, approximate_ms)")
def plan_bucket_sizes(spark, sf):
    rows = [(u, n, ReportInterval(u, n).approximate_ms) for u, n in (("months", 2), ("weeks", 1), ("days", 3), ("hours", 6), ("fixed", 1500))]
    return spark.createDataFrame(rows, "unit string, n int, approximate_ms long")


@query("SELECT * FROM (VALUES ('15m', 900000), ('1h 30m', 5400000), ('90s', 90000), ('250ms', 250), ('2d', 172800000), ('1w', 604800000), ('0s', NULL), ('soon', NULL)) v(written, ms)")
def plan_durations(spark, sf):
    rows = []
    for text in ("15m", "1h 30m", "90s", "250ms", "2d", "1w", "0s", "soon"):
        try:
            rows.append((text, duration_ms(text)))
        except EngineError:
            rows.append((text, None))
    return spark.createDataFrame(rows, "written string, ms int")


@query("SELECT * FROM (VALUES ('same', 'stack'), ('fewer components', 'reduce'), ('other components', 'join'), ('no time', 'join'), ('other subject', 'incompatible')) v(what, how)")
def plan_composition(spark, sf):
    a = ("s", "t", ("x",))
    others = {"same": a, "fewer components": ("s", "t", ()), "other components": ("s", "t", ("y",)), "no time": ("s", None, ()), "other subject": ("o", "t", ("x",))}
    return spark.createDataFrame([(what, planner.composition(a, b)) for what, b in others.items()], "what string, how string")


@query("""SELECT * FROM (VALUES ('any_on', 'categorical', 'last'), ('all_on', 'categorical', 'last'), ('count_non_zero', 'count', 'sum'), ('sum', 'measure', 'mean'), ('ratio', 'measure', 'mean')) v(op, kind, reduced_by)""")
def derived_kinds(spark, sf):
    rows = [(op, k.value, k.default_aggregate.value) for op in ("any_on", "all_on", "count_non_zero", "sum", "ratio") for k in [X.inferred_kind(op)]]
    return spark.createDataFrame(rows, "op string, kind string, reduced_by string")


@query("""SELECT * FROM (VALUES ('column', 'a', true), ('struct', 'a,b', false), ('concat', 'a,b', false), ('coalesce', 'a,b', false), ('parse', 'a', false), ('epoch', 'a', false)) v(kind, needs, is_identity)""")
def expression_dependencies(spark, sf):
    made = [X.column("a"), X.struct_key("a", "b"), X.concat_key(["a", "b"], "-"), X.coalesce_key("a", "b"), X.parse_datetime("a", "%Y"), X.from_epoch("a", "ms")]
    return spark.createDataFrame([(e.kind, ",".join(e.columns), e.is_identity) for e in made], "kind string, needs string, is_identity boolean")


def _outcome(f) -> str:
    try:
        f()
    except EngineError as e:
        return type(e).__name__
    return "fine"


@query("""SELECT * FROM (VALUES ('a source as it should be', 'fine'), ('a mapped column is missing', 'BindingError'), ('no subject', 'BindingError'), ('a promise is not kept', 'BindingError'), ('a computed column needs another', 'BindingError'),
          ('an unknown measurement', 'RequestError'), ('an unknown quality', 'RequestError'), ('an empty request', 'RequestError'), ('an unknown field', 'RequestError'), ('a measurement without a policy', 'SchemaError'), ('a number filled by text', 'SchemaError'), ('a name twice', 'SchemaError')) v(what, outcome)""")
def refusals(spark, sf):
    """What is refused, and as what kind of error, before any job runs."""
    ev, schema = table(spark, sf, "events"), event_schema()
    good, u = B.BoundSource.identity("e", ev, schema), event_universe(spark, sf, schema)
    m = schema.measurements[0]
    cases = {
        "a source as it should be": lambda: good.validated(schema),
        "a mapped column is missing": lambda: good.map("value", "nope").validated(schema),
        "no subject": lambda: B.BoundSource("e", ev, {"ts": "ts"}).validated(schema),
        "a promise is not kept": lambda: B.BoundSource("e", ev, {"user_id": "user_id"}, provides=("value",)).validated(schema),
        "a computed column needs another": lambda: good.map_expr("ts", X.column("nope")).validated(schema),
        "an unknown measurement": lambda: u.subset(SubsetRequest(("nope",))),
        "an unknown quality": lambda: u.subset(SubsetRequest(("value",), ("nope",))),
        "an empty request": lambda: u.subset(SubsetRequest()),
        "an unknown field": lambda: SubsetRequest.from_json({"mesurements": ["value"]}),
        "a measurement without a policy": lambda: Schema("x", "s", "t", (Measurement("a"),)).validated(),
        "a number filled by text": lambda: Schema("x", "s", "t", (Measurement("a", null_value="text"),)).validated(strict=False),
        "a name twice": lambda: Schema("x", "s", "t", (m, m)).validated(),
    }
    return spark.createDataFrame([(what, _outcome(f)) for what, f in cases.items()], "what string, outcome string")


@query("""SELECT * FROM (VALUES ('sliding', 300000, 3600000, 3, NULL), ('instant', 60000, 0, 1, '%Y'), ('tumbling', 90000, 86400000, 2, NULL)) v(kind, ttl_ms, duration_ms, min_samples, time_format)""")
def policy_json(spark, sf):
    texts = ('{"max_staleness": "5m", "windowing": {"sliding": {"duration": "1h", "min_samples": 3}}}', '{"time_format": "%Y"}', '{"ttl": 90, "windowing": {"Tumbling": {"duration": "1d", "min_samples": 2}}}')
    rows = [(p.kind, p.ttl, p.duration, p.min_samples, p.time_format) for p in map(SignalPolicy.from_json, texts)]
    return spark.createDataFrame(rows, "kind string, ttl_ms int, duration_ms int, min_samples int, time_format string")


_JSON_SCHEMA = """{"name": "events", "subject": "user_id", "time": "ts", "qualities": [], "measurements": [{"name": "bought", "kind": "categorical"}, {"name": "seen", "kind": "categorical"}],
    "derivations": [{"name": "any", "computation": {"pointwise": {"type": "any_on", "inputs": ["bought", "seen"]}}, "kind": "categorical"}, {"name": "both", "computation": {"pointwise": {"type": "count_non_zero", "inputs": ["bought", "seen"]}}, "kind": "count"}]}"""


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS ts, max((event_type = 'purchase')::INTEGER) AS bought, max((event_type = 'view')::INTEGER) AS seen FROM events GROUP BY 1, 2)
          SELECT user_id, ts, greatest(bought, seen)::INTEGER AS "any", (bought + seen)::INTEGER AS both FROM e""")
def schema_json(spark, sf):
    """Measurements and derivations declared in JSON."""
    schema = Schema.from_json(_JSON_SCHEMA)
    flags = table(spark, sf, "events").groupBy("user_id", floor_to("ts", DAY).alias("ts")).agg(*[F.max((F.col("event_type") == t).cast("int")).alias(n) for n, t in (("bought", "purchase"), ("seen", "view"))])
    return Universe.build(schema, [B.BoundSource.identity("e", flags, schema)], now=NOW).subset_raw(SubsetRequest(("any", "both"))).df


@query("""SELECT * FROM (VALUES ('PRE03M', -3, -1, 'reach', 14, 10, 1, 0.8), ('L06M', -5, 0, 'last', 14, 10, 1, 0.8)) v(name, low, high, anchor, first_reach, targets, merged, autotune)""")
def configuration_toml(spark, sf):
    from ..causal.config import parse

    schema, campaign, study = parse(
        'subject = "npi"\n', '[campaign]\nstart = "2024-01"\nreach_start = "2025-02"\ntargets = 10\n',
        '[study]\nmeasures = ["brx"]\ngates = ["state"]\n[[study.windows]]\nname = "PRE03M"\nlow = -3\nhigh = -1\n[[study.windows]]\nname = "L06M"\nlow = -5\nhigh = 0\nanchor = "last"\n[study.groups]\ndefault = [[1, 2], [3]]\n[study.autotune]\ntarget = 0.8\n[[study.autotune.steps]]\ncolumn = "brx_L06M_decile"\ndistance = 2\n',
    )
    rows = [(w.name, w.low, w.high, w.anchor, campaign.first_reach, campaign.targets, study.groups.mapping("brx")[2], study.autotune.target) for w in study.windows]
    return spark.createDataFrame(rows, "name string, low int, high int, anchor string, first_reach int, targets int, merged int, autotune double")


@query("""SELECT 'events' AS stage, count(*) AS n_rows FROM events UNION ALL SELECT 'purchases', count(*) FILTER (event_type = 'purchase') FROM events
          UNION ALL SELECT 'days', count(*) FROM (SELECT DISTINCT user_id, time_bucket(INTERVAL 1 DAY, ts) FROM events WHERE event_type = 'purchase')""")
def stage_trace(spark, sf):
    """Rows of each stage, counted on the way by one job."""
    ev, seen = traced(table(spark, sf, "events"), "events")
    bought, kept = traced(ev.where("event_type = 'purchase'"), "purchases")
    days, cells = traced(bought.groupBy("user_id", floor_to("ts", DAY).alias("ts")).agg(F.sum("value").alias("v")), "days")
    days.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(n, o.get["rows"]) for n, o in (("events", seen), ("purchases", kept), ("days", cells))], "stage string, n_rows long")


@query("SELECT * FROM (VALUES ('a', 'warning', true), ('b', 'error', false)) v(stage, level, ok_so_far)")
def drift_checks(spark, sf):
    """Over a tenth fewer rows is a warning, under half an error; 5 % is neither."""
    seen, out = Collector(), []
    with seen.section("checks"):
        for name, after in (("fine", 105), ("a", 80), ("b", 30)):
            drift(100, after, seen, name)
            if seen.issues and seen.issues[-1][1] == name:
                out.append((name, seen.issues[-1][0], seen.ok))
    return spark.createDataFrame(out, "stage string, level string, ok_so_far boolean")


@query("""SELECT 'purchases' AS stage, CASE WHEN b / a > 2 OR b / a < 0.5 THEN 'error' WHEN abs(b / a - 1) > 0.1 THEN 'warning' END AS level FROM (SELECT count(*) AS a, count(*) FILTER (event_type = 'purchase') AS b FROM events)
          UNION ALL SELECT 'without errors', CASE WHEN b / a > 2 OR b / a < 0.5 THEN 'error' WHEN abs(b / a - 1) > 0.1 THEN 'warning' END FROM (SELECT count(*) AS a, count(*) FILTER (event_type <> 'error') AS b FROM events)""")
def drift_of_frames(spark, sf):
    seen, ev = Collector(), table(spark, sf, "events")
    for name, kept in (("purchases", "event_type = 'purchase'"), ("without errors", "event_type <> 'error'")):
        drift_of(ev, ev.where(kept), seen, name)
    return spark.createDataFrame([(name, level) for level, name, _ in seen.issues], "stage string, level string")


@query(grid_sql("6 HOUR", 2) + """, r AS (SELECT user_id, date_trunc('month', t) AS m, count(v) AS n, count(*) FILTER (v IS NULL) AS gone FROM d GROUP BY 1, 2)
    SELECT 'grid' AS what, count(*) AS n_rows, count(DISTINCT user_id) AS subjects, count(DISTINCT t) AS times, 0::BIGINT AS contributing, 0::BIGINT AS missing FROM d
    UNION ALL SELECT 'report', count(*), count(DISTINCT user_id), count(DISTINCT m), sum(n)::BIGINT, sum(gone)::BIGINT FROM r""")
def subset_info(spark, sf):
    """Counts of a result, and the interval statistics of a report."""
    u, rows = event_universe(spark, sf, event_schema()), []
    for what, report in (("grid", None), ("report", ReportInterval("months"))):
        info = u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR, report=report)).info()
        stats = info.get("interval_stats", {}).get("value", {"n": 0, "null_count": 0})
        rows.append((what, info["rows"], info["subjects"], info["times"], stats["n"], stats["null_count"]))
    return spark.createDataFrame(rows, "what string, n_rows long, subjects long, times long, contributing long, missing long")


@query("SELECT 'value' AS measurement, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, count(DISTINCT user_id) AS n_subjects, min(ts) AS first_time, max(ts) AS last_time FROM events")
def measurement_diagnostics(spark, sf):
    u = event_universe(spark, sf, event_schema())
    if not all(size > 0 for size in u.memory_summary().values()):
        raise AssertionError("a table of no size")
    return u.diagnostics()


@query("SELECT * FROM (VALUES ('value', 'typed+plain', '', 'event_type')) v(measurement, sources, components, crushed)")
def build_info(spark, sf):
    """What a measurement was built from: a source without the component makes the other one's go."""
    schema = Schema("events", "user_id", "ts", (Measurement("value", components=("event_type",), policy=SignalPolicy.instant(60), sample_rate_ms=60_000),)).validated()
    ev = table(spark, sf, "events")
    u = Universe.build(schema, [B.BoundSource.identity("typed", ev, schema), B.BoundSource.identity("plain", ev.drop("event_type"), schema).with_priority(1)], now=NOW)
    rows = [(n, "+".join(d["sources"]), ",".join(d["components"]), ",".join(d["crushed"])) for n, d in u.describe().items()]
    return spark.createDataFrame(rows, "measurement string, sources string, components string, crushed string")


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, round(avg(value), 6) AS value FROM events WHERE user_id IN (3, 4, 5) GROUP BY 1, 2
          UNION ALL SELECT user_id, time_bucket(INTERVAL 1 DAY, ts), round(avg(value), 6) FROM events WHERE user_id IN (6) GROUP BY 1, 2""")
def several_requests(spark, sf):
    """A batch of requests; observed days of each are stacked."""
    schema = Schema("events", "user_id", "ts", (Measurement("value", policy=SignalPolicy.instant("24h"), sample_rate_ms=DAY),)).validated()
    u = Universe.build(schema, [B.BoundSource.identity("events", table(spark, sf, "events"), schema)], now=NOW)
    parts = u.execute([SubsetRequest(("value",), subjects=SubjectFilter(include=who), interval_ms=DAY) for who in ((3, 4, 5), (6,))])
    return rounded(parts[0].df.unionByName(parts[1].df).where("value is not null"))


@query("SELECT * FROM (VALUES ('count', 'sum'), ('measure', 'mean'), ('average', 'mean'), ('categorical', 'last'), ('binary', 'any')) v(kind, reduced_by)")
def default_aggregates(spark, sf):
    return spark.createDataFrame([(k.value, k.default_aggregate.value) for k in Kind], "kind string, reduced_by string")
