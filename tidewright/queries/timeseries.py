"""Queries of the time-series half over ``events``, ``orders``, ``lineitem`` and ``customer``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import expr as X
from ..model import (
    Aggregate, Derivation, Kind, Measurement, OverSubjects, OverTime, Pointwise, Quality, ReportInterval, Schema, SignalPolicy, SubjectFilter, SubsetRequest, SyntheticSubject, TimeRange, TruthMapping, Upsample,
)
from ..operators import align as A
from ..operators import relational as R
from ..plans.universe import Universe
from ..sources.bind import BoundSource, Unpivot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: After the last row of every test table: historical grids are not cut short.
NOW = datetime(2030, 1, 1)
HOUR, DAY = 3_600_000, 86_400_000


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")



def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a few places: sums depend on their order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- grids and policies ----------------------------------------------------------------------------------------


def event_schema(rate_ms: int = 6 * HOUR, ttl_s: int = 18 * 3600, derivations: tuple = (), **measure) -> Schema:
    value = Measurement("value", measure.pop("kind", Kind.MEASURE), policy=SignalPolicy.instant(ttl_s), sample_rate_ms=rate_ms, **measure)
    return Schema("events", "user_id", "ts", (value,), (), derivations).validated()


def event_universe(spark: SparkSession, sf: str, schema: Schema) -> Universe:
    return Universe.build(schema, [BoundSource.identity("events", table(spark, sf, "events"), schema)], now=NOW)


def grid_sql(bucket: str, cells: int, agg: str = "avg(value)", where: str = "true", value: str = "value") -> str:
    """CTEs: c (cells), g (dense grid), d (carried)."""
    return f"""WITH c AS (SELECT user_id, time_bucket(INTERVAL {bucket}, ts) AS t, {agg} AS v FROM events WHERE {where} GROUP BY 1, 2),
        p AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL {bucket})) AS t FROM c),
        g AS (SELECT user_id, p.t, c.v FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN p LEFT JOIN c USING (user_id, t)),
        d AS (SELECT user_id, t, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN {cells} PRECEDING AND CURRENT ROW) AS v FROM g)"""


@query(grid_sql("6 HOUR", 2) + " SELECT user_id, t AS ts, round(v, 6) AS value FROM d")
def instant_grid_ttl(spark, sf):
    """Six-hour cells, a value holds for 18 hours, dense over all users."""
    u = event_universe(spark, sf, event_schema())
    return rounded(u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR)).df)


@query(grid_sql("6 HOUR", 2) + " SELECT user_id, t AS ts, round(coalesce(v, -1), 6) AS value FROM d")
def instant_null_fill(spark, sf):
    u = event_universe(spark, sf, event_schema(null_value=-1.0))
    return rounded(u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR)).df)


@query(grid_sql("6 HOUR", 0) + " SELECT user_id, t AS ts, round(coalesce(v, 0), 6) AS value FROM d")
def join_null_fill(spark, sf):
    u = event_universe(spark, sf, event_schema(ttl_s=6 * 3600, null_value_extension=0.0))
    return rounded(u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR)).df)


@query(grid_sql("1 DAY", 0, "max(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END)") + " SELECT user_id, t AS ts, v AS bought FROM d")
def instant_binary_max(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("bought"))
    m = Measurement("bought", Kind.BINARY, policy=SignalPolicy.instant(86_400), sample_rate_ms=DAY, truth=TruthMapping(("purchase", "signup")))
    schema = Schema("e", "user_id", "ts", (m,)).validated()
    return Universe.build(schema, [BoundSource.identity("e", events, schema)], now=NOW).subset(SubsetRequest(("bought",), interval_ms=DAY)).df


@query("SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END::INTEGER AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def truth_mapping_tri_state(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", X.truth("l_returnflag", TruthMapping(("R",), ("N",))).alias("flag"))
    return li.groupBy("l_returnflag", "flag").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, avg(value) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
          v AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, avg(value) AS view FROM events WHERE event_type = 'view' GROUP BY 1, 2)
          SELECT user_id, ts, round(purchase, 6) AS purchase, round(view, 6) AS view FROM p FULL JOIN v USING (user_id, ts)""")
def raw_subset_full_outer(spark, sf):
    """Observed days only; measures from two sources meet in a full join."""
    ev = table(spark, sf, "events").select("user_id", C.floor_to("ts", DAY).alias("ts"), "event_type", "value")
    ms = tuple(Measurement(k, policy=SignalPolicy.instant(60), sample_rate_ms=DAY) for k in ("purchase", "view"))
    schema = Schema("e", "user_id", "ts", ms).validated()
    sources = [BoundSource(k, ev.where(F.col("event_type") == k), {"user_id": "user_id", "ts": "ts", k: "value"}) for k in ("purchase", "view")]
    return rounded(Universe.build(schema, sources, now=NOW).subset_raw(SubsetRequest(("purchase", "view"))).df)


@query("""SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS ts, round(CASE WHEN count(value) >= 2 THEN avg(value) END, 6) AS value
          FROM events GROUP BY 1, 2, 3""")
def tumbling_min_samples(spark, sf):
    return rounded(A.tumbling(table(spark, sf, "events"), "ts", "value", ["user_id", "event_type"], DAY, Aggregate.MEAN, 2))


@query("""SELECT event_id, user_id, ts, round(CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END, 6) AS value FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW)""")
def sliding_range_avg(spark, sf):
    out = A.sliding(table(spark, sf, "events"), "ts", "value", ["user_id"], DAY, Aggregate.MEAN, 2)
    return rounded(out.select("event_id", "user_id", "ts", "value"))


_DAILY = "WITH b AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2)"
_FINE = """, s AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM b GROUP BY 1),
        g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 12 HOUR)) AS t FROM s), j AS (SELECT user_id, t, v FROM g LEFT JOIN b USING (user_id, t))"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return A.tumbling(table(spark, sf, "events"), "ts", "value", ["user_id"], DAY, Aggregate.MEAN)


@query(_DAILY + _FINE + " SELECT user_id, t AS ts, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t), 6) AS value FROM j")
def upsample_ffill(spark, sf):
    return rounded(A.resample(daily(spark, sf), "ts", "value", ["user_id"], 12 * HOUR, Upsample.FORWARD_FILL))


@query(_DAILY + _FINE + """, k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t) AS t0,
            last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t) AS v0,
            first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
            first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM j)
          SELECT user_id, t AS ts, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(t) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 6) AS value FROM k""")
def upsample_linear(spark, sf):
    return rounded(A.resample(daily(spark, sf), "ts", "value", ["user_id"], 12 * HOUR, Upsample.INTERPOLATE))


@query(_DAILY + _FINE + " SELECT user_id, t AS ts, round(v, 6) AS value FROM j")
def upsample_null(spark, sf):
    return rounded(A.resample(daily(spark, sf), "ts", "value", ["user_id"], 12 * HOUR, Upsample.NULL))


def _downsample(how: str, sql: str) -> None:
    @query(f"SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, round({sql}, 6) AS value FROM events GROUP BY 1, 2", f"downsample_{how}")
    def run(spark, sf):
        return rounded(A.resample(table(spark, sf, "events"), "ts", "value", ["user_id"], DAY, how))


for _how, _sql in (("mean", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("sum", "sum(value)"), ("last", "arg_max(value, ts)")):
    _downsample(_how, _sql)


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
          v AS (SELECT user_id, ts AS seen, value FROM events WHERE event_type = 'view')
          SELECT event_id, p.user_id AS user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(seen) <= 172800000000 THEN value END AS viewed,
                 CASE WHEN epoch_us(ts) - epoch_us(seen) <= 172800000000 THEN seen END AS seen
          FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.seen""")
def asof_backward_tolerance(spark, sf):
    """Each purchase with the user's last view in the two days before."""
    ev = table(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("viewed"))
    return A.asof(left, right, "ts", ["user_id"], ["viewed"], 2 * DAY, "seen").select("event_id", "user_id", "ts", "viewed", "seen")


@query("""WITH d AS (SELECT user_id, event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) AS gap FROM events)
          SELECT round(quantile_cont(gap / 1000, 0.5))::BIGINT AS rate_ms FROM d WHERE gap > 0""")
def sample_rate_estimate(spark, sf):
    return A.estimate_rate(table(spark, sf, "events"), "ts", ["user_id", "event_type"])


@query("SELECT min(ts) AS first_time, max(ts) AS last_time, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000)::BIGINT AS span_ms FROM events")
def time_extent(spark, sf):
    return C.time_extent(table(spark, sf, "events"), "ts")


@query("""WITH e AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2)
          SELECT count(*) AS n_rows, count(v) AS n_filled, round(count(v) / count(*), 6) AS fill_rate, count(DISTINCT user_id) AS n_keys FROM (""" + grid_sql("6 HOUR", 0) + " SELECT user_id, v FROM d)")
def policy_fill_rate(spark, sf):
    grid = A.instant(table(spark, sf, "events"), "ts", {"value": "mean"}, ["user_id"], 6 * HOUR)
    return rounded(A.policy_stats(grid, "value", ["user_id"]))


# -- reports ---------------------------------------------------------------------------------------------------


def _report_sql(bucket: str, rows: str, subject: str, time: str, value: str, agg: str = "avg") -> str:
    return f"""SELECT {subject}, {bucket} AS {time}, round({agg}({value}), 6) AS {value}, count({value}) AS {value}_n, count(*) FILTER ({value} IS NULL) AS {value}_null_count,
        round(stddev_samp({value}), 6) AS {value}_std, min({value}) AS {value}_min, max({value}) AS {value}_max, round(stddev_samp({value}) / sqrt(count({value})), 6) AS {value}_stderr
        FROM {rows} GROUP BY 1, 2"""


@query(_report_sql("date_trunc('month', o_orderdate)::TIMESTAMP", "orders", "o_custkey", "o_orderdate", "o_totalprice"))
def report_month(spark, sf):
    return rounded(A.report(table(spark, sf, "orders"), ReportInterval("months"), "o_custkey", "o_orderdate", {"o_totalprice": "mean"}))


@query(_report_sql("make_timestamp(year(o_orderdate), ((month(o_orderdate) - 1) // 3) * 3 + 1, 1, 0, 0, 0)", "orders", "o_custkey", "o_orderdate", "o_totalprice", "max"))
def report_quarter_override_max(spark, sf):
    return rounded(A.report(table(spark, sf, "orders"), ReportInterval("months", 3, overrides={"o_totalprice": Aggregate.MAX}), "o_custkey", "o_orderdate", {"o_totalprice": "mean"}))


@query(_report_sql("date_trunc('week', ts)::TIMESTAMP", "events", "user_id", "ts", "value", "sum"))
def report_week(spark, sf):
    return rounded(A.report(table(spark, sf, "events"), ReportInterval("weeks"), "user_id", "ts", {"value": "sum"}))


@query(_report_sql("date_trunc('month', t)::TIMESTAMP", "(" + grid_sql("6 HOUR", 2) + " SELECT user_id, t, v AS value FROM d)", "user_id", "ts", "value"))
def report_on_grid(spark, sf):
    """Monthly statistics of the aligned signal; empty cells count as nulls."""
    u = event_universe(spark, sf, event_schema())
    return rounded(u.subset(SubsetRequest(("value",), interval_ms=6 * HOUR, report=ReportInterval("months"))).df)


# -- sources, components, filters ------------------------------------------------------------------------------


@query("""SELECT l_orderkey, kind, count(*) AS n, round(sum(rate), 6) AS rate FROM (
          SELECT l_orderkey, 'discount' AS kind, l_discount AS rate FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem) WHERE rate IS NOT NULL GROUP BY 1, 2""")
def unpivot_discount_tax(spark, sf):
    u = Unpivot("rate", {"l_discount": {"kind": "discount"}, "l_tax": {"kind": "tax"}})
    long = u.run(table(spark, sf, "lineitem"), ["l_orderkey"])
    return rounded(long.groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"), F.sum("rate").alias("rate")))


@query("""SELECT o_custkey, o_orderdate, o_totalprice FROM (
          SELECT o_custkey, o_orderdate, round(sum(o_totalprice), 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2
          UNION ALL SELECT o_custkey, o_orderdate, round(o_totalprice, 6) FROM orders WHERE o_orderstatus = 'F')""")
def stack_crush_components(spark, sf):
    """A fragment with priorities and one without: the component goes before they stack."""
    od = table(spark, sf, "orders")
    a = od.where("o_orderstatus = 'O'").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    b = od.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", "o_totalprice")
    return rounded(R.stack([a, b], ["o_custkey", "o_orderdate"], "o_totalprice", ["o_orderpriority"], "sum"))


_DAY_SQL = "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, {} AS value FROM events GROUP BY 1, 2"


def _crush(how: str, sql: str) -> None:
    @query(_DAY_SQL.format(sql), f"component_crush_{how}")
    def run(spark, sf):
        ev = table(spark, sf, "events").withColumn("day", C.floor_to("ts", DAY))
        return rounded(R.crush(ev, ["user_id", "day"], {"value": how}, ["event_type", "event_id"]))


for _how, _sql in (
    ("sum", "round(sum(value), 6)"), ("mean", "round(avg(value), 6)"), ("min", "min(value)"), ("any", "max(value)"), ("all", "min(value)"), ("count", "count(value)"),
    ("first", "arg_min(value, (event_type, event_id))"), ("last", "arg_max(value, (event_type, event_id))"), ("most_recent", "arg_max(value, (event_type, event_id))"), ("least_recent", "arg_min(value, (event_type, event_id))"), ("linear_trend", "round(avg(value), 6)"),
):
    _crush(_how, _sql)


@query("SELECT user_id, round(sum(value), 6) AS value FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1")
def component_filter_include(spark, sf):
    ev = R.filter_levels(table(spark, sf, "events"), {"event_type": {"include": ["purchase", "view"]}})
    return rounded(R.crush(ev, ["user_id"], {"value": "sum"}))


@query("SELECT user_id, round(sum(value), 6) AS value FROM events WHERE event_type NOT IN ('error') GROUP BY 1")
def component_filter_exclude(spark, sf):
    ev = R.filter_levels(table(spark, sf, "events"), {"event_type": {"exclude": ["error"]}})
    return rounded(R.crush(ev, ["user_id"], {"value": "sum"}))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IN (1, 2, 3, 5, 8) GROUP BY 1, 2")
def subject_include(spark, sf):
    return R.filter_subjects(table(spark, sf, "events"), "user_id", SubjectFilter(include=(1, 2, 3, 5, 8))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (1, 2, 3, 5, 8) GROUP BY 1")
def subject_exclude(spark, sf):
    return R.filter_subjects(table(spark, sf, "events"), "user_id", SubjectFilter(exclude=(1, 2, 3, 5, 8))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def time_range_half_open(spark, sf):
    return R.filter_time(table(spark, sf, "events"), "ts", TimeRange("2024-01-10", "2024-01-12")).select("event_id", "ts")


def customer_universe(spark: SparkSession, sf: str) -> Universe:
    price = Measurement("o_totalprice", Kind.COUNT, components=("o_orderpriority",), policy=SignalPolicy.instant(86_400), sample_rate_ms=DAY, aggregate=Aggregate.SUM)
    schema = Schema("customers", "o_custkey", "o_orderdate", (price,), (Quality("c_mktsegment"), Quality("n_name", "NOWHERE"))).validated()
    people = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    sources = [BoundSource.identity("orders", table(spark, sf, "orders"), schema), BoundSource("people", people, {"o_custkey": "c_custkey", "c_mktsegment": "c_mktsegment", "n_name": "n_name"})]
    return Universe.build(schema, sources, now=NOW)


@query("""SELECT o_custkey, o_orderdate, round(sum(o_totalprice), 6) AS o_totalprice, any_value(c_mktsegment) AS c_mktsegment, any_value(n_name) AS n_name
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""")
def quality_join_filter(spark, sf):
    req = SubsetRequest(("o_totalprice",), ("c_mktsegment", "n_name"), quality_filter={"c_mktsegment": ["BUILDING", "MACHINERY"]})
    return rounded(customer_universe(spark, sf).subset_raw(req).df)


@query("SELECT c_custkey AS o_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 5)")
def qualities_only(spark, sf):
    names = [r[0] for r in table(spark, sf, "nation").where("n_nationkey < 5").select("n_name").collect()]  # a fixed small table
    return customer_universe(spark, sf).subset(SubsetRequest((), ("c_mktsegment", "n_name"), quality_filter={"n_name": names})).df


@query("""SELECT user_id::VARCHAR AS user_id, day, round(avg(value), 6) AS value FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events) GROUP BY 1, 2
          UNION ALL SELECT 'fleet', day, round(avg(value), 6) FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, avg(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def synthetic_all_mean(spark, sf):
    base = daily(spark, sf).withColumnRenamed("ts", "day")
    return rounded(R.add_synthetic(base, [SyntheticSubject("fleet")], "user_id", "day", {"value": Aggregate.MEAN}))


@query("""WITH b AS (SELECT o_custkey, c_mktsegment, date_trunc('year', o_orderdate)::TIMESTAMP AS yr, sum(o_totalprice) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
          SELECT 'all ' || c_mktsegment AS o_custkey, yr, c_mktsegment, round(sum(spent), 6) AS spent FROM b GROUP BY 2, 3""")
def synthetic_by_quality(spark, sf):
    od, cu = table(spark, sf, "orders"), table(spark, sf, "customer")
    base = od.join(cu, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey", "c_mktsegment", C.bucket_start("o_orderdate", "months", 12).alias("yr")).agg(F.sum("o_totalprice").alias("spent"))
    rows = R.synthetic_rows(base, SyntheticSubject("all {c_mktsegment}", Aggregate.SUM, group_by=("c_mktsegment",)), "o_custkey", "yr", {"spent": Aggregate.SUM})
    return rounded(rows.select("o_custkey", "yr", "c_mktsegment", "spent"))


@query("SELECT user_id, event_type, day, value FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS day, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY event_id % 2, event_id) AS k FROM events) WHERE k = 1")
def dedup_first_wins(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", C.floor_to("ts", DAY))
    halves = {name: ev.where(F.col("event_id") % 2 == k) for k, name in enumerate(("even", "odd"))}
    return R.dedup(halves, ["user_id", "event_type", "day"], "first_wins", tie="event_id").select("user_id", "event_type", "day", "value")


@query("SELECT user_id, event_type, day, value, CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS source FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS day, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY event_id % 2 DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_last_wins(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", C.floor_to("ts", DAY))
    halves = {name: ev.where(F.col("event_id") % 2 == k) for k, name in enumerate(("even", "odd"))}
    return R.dedup(halves, ["user_id", "event_type", "day"], "last_wins", tie="event_id", tag="source").select("user_id", "event_type", "day", "value", "source")


@query("""WITH g AS (SELECT user_id, d FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS d FROM events))
          SELECT user_id, d AS ts FROM g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.user_id AND time_bucket(INTERVAL 1 DAY, e.ts) = g.d)""")
def coverage_gaps(spark, sf):
    cells = daily(spark, sf)
    grid = A.dense(cells, "ts", ["user_id"], DAY).select("user_id", "ts")
    return R.coverage_gaps(grid, cells.select("user_id", "ts"), ["user_id", "ts"])[0]


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_key(spark, sf):
    return R.top_by_count(table(spark, sf, "events"), "event_type")


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS subjects, count(DISTINCT time_bucket(INTERVAL 6 HOUR, ts)) AS times FROM events")
def distinct_counts(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("subjects"), F.count_distinct(C.floor_to("ts", 6 * HOUR)).alias("times"))


# -- derivations -----------------------------------------------------------------------------------------------

_GRID3 = grid_sql("1 DAY", 2)
_TIME_SQL = {
    "derivative": "(v - lag(v) OVER w) / ((epoch_us(t) - epoch_us(lag(t) OVER w)) / 1000000.0::DOUBLE)",
    "rolling_mean": "avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "rolling_sum": "sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "lag": "lag(v, 2) OVER w", "lead": "lead(v, 2) OVER w", "cum_sum": "CASE WHEN v IS NOT NULL THEN sum(v) OVER w END", "diff": "v - lag(v, 2) OVER w",
}
_N = {"rolling_mean": 3, "rolling_sum": 3, "lag": 2, "lead": 2, "diff": 2}


def _derive(op: str, sql: str) -> None:
    places = 12 if op == "derivative" else 6

    @query(f"{_GRID3} SELECT user_id, t AS ts, round({sql}, {places}) AS out FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)", f"derive_{op}")
    def run(spark, sf):
        d = Derivation("out", OverTime(op, "value", _N.get(op, 1), "s"))
        u = event_universe(spark, sf, event_schema(DAY, 3 * 86_400, (d,)))
        return rounded(u.subset(SubsetRequest(("out",), interval_ms=DAY)).df, places)


for _op, _sql in _TIME_SQL.items():
    _derive(_op, _sql)

_SUBJECT_SQL = {
    "percent_of": "round(v * 100 / sum(v) OVER (PARTITION BY t), 6)",
    "rank": "CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY v DESC NULLS LAST, user_id) END::INTEGER",
    "z_score": "round((v - avg(v) OVER (PARTITION BY t)) / nullif(stddev_samp(v) OVER (PARTITION BY t), 0), 6)",
    "deviation": "round(v - avg(v) OVER (PARTITION BY t), 6)",
    "quantile": "CASE WHEN v IS NOT NULL THEN ceil((rank() OVER (PARTITION BY t ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY t, v) - 1) / 2) / count(v) OVER (PARTITION BY t) * 4) END::INTEGER",
    "bucket": "CASE WHEN v <= 10 THEN 0 WHEN v <= 50 THEN 1 WHEN v <= 100 THEN 2 ELSE 3 END::INTEGER",
}


def _across(op: str, sql: str) -> None:
    @query(f"{_GRID3} SELECT user_id, t AS ts, {sql} AS out FROM d", f"xsec_{op}")
    def run(spark, sf):
        d = Derivation("out", OverSubjects(op, "value", 4, (10, 50, 100)))
        u = event_universe(spark, sf, event_schema(DAY, 3 * 86_400, (d,)))
        return rounded(u.subset(SubsetRequest(("out",), interval_ms=DAY)).df)


for _op, _sql in _SUBJECT_SQL.items():
    _across(_op, _sql)

_WIDE_SQL = "WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, " + ", ".join(f"avg(value) FILTER (event_type = '{t}') AS {t}" for t in ("click", "purchase", "view")) + " FROM events GROUP BY 1, 2)"
_POINT_SQL = {
    "any_on": "(greatest(click, purchase, view) > 0)::INTEGER", "all_on": "(least(click, purchase, view) > 0)::INTEGER",
    "count_non_zero": "(coalesce((click != 0)::INTEGER, 0) + coalesce((purchase != 0)::INTEGER, 0) + coalesce((view != 0)::INTEGER, 0))::INTEGER",
    "sum": "round(coalesce(click, 0) + coalesce(purchase, 0) + coalesce(view, 0), 6)",
    "mean": "round((coalesce(click, 0) + coalesce(purchase, 0) + coalesce(view, 0)) / nullif((click IS NOT NULL)::INTEGER + (purchase IS NOT NULL)::INTEGER + (view IS NOT NULL)::INTEGER, 0), 6)",
    "max": "round(greatest(click, purchase, view), 6)", "min": "round(least(click, purchase, view), 6)", "difference": "round(click - purchase, 6)", "ratio": "round(click / nullif(purchase, 0), 6)",
}


def _point(op: str, sql: str) -> None:
    @query(f"{_WIDE_SQL} SELECT user_id, day, {sql} AS out FROM w", f"pointwise_{op}")
    def run(spark, sf):
        ev = table(spark, sf, "events")
        wide = ev.groupBy("user_id", C.floor_to("ts", DAY).alias("day")).agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in ("click", "purchase", "view")])
        inputs = ("click", "purchase") if op in ("difference", "ratio") else ("click", "purchase", "view")
        return rounded(wide.select("user_id", "day", X.pointwise(Pointwise(op, inputs)).alias("out")))


for _op, _sql in _POINT_SQL.items():
    _point(_op, _sql)


@query(f"""{_GRID3}, a AS (SELECT user_id, t, avg(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smooth FROM d)
           SELECT user_id, t AS ts, round(smooth * 100 / sum(smooth) OVER (PARTITION BY t), 6) AS share FROM a""")
def derivation_chain(spark, sf):
    """A share of a rolling mean: the inner derivation is not returned."""
    ds = (Derivation("share", OverSubjects("percent_of", "smooth")), Derivation("smooth", OverTime("rolling_mean", "value", 3)))
    u = event_universe(spark, sf, event_schema(DAY, 3 * 86_400, ds))
    return rounded(u.subset(SubsetRequest(("share",), interval_ms=DAY)).df)


# -- key expressions -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS joined, coalesce(o_orderstatus, o_orderpriority) AS first_of,
          make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 0, 0, 0) AS of_parts, o_orderdate AS parsed, to_timestamp(o_orderkey)::TIMESTAMP AS of_epoch,
          o_orderdate + INTERVAL '10:30:00' AS of_date_time FROM orders""")
def expr_keys(spark, sf):
    od = table(spark, sf, "orders").withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate"), "d": F.day("o_orderdate"), "txt": F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"), "clock": F.lit("10:30:00")})
    return od.select(
        "o_orderkey", X.concat_key(["o_orderstatus", "o_orderpriority"], "-").to_column("joined"), X.coalesce_key("o_orderstatus", "o_orderpriority").to_column("first_of"), X.datetime_parts("y", "m", "d").to_column("of_parts"),
        X.parse_datetime("txt", "%Y/%m/%d %H:%M:%S").to_column("parsed"), X.from_epoch("o_orderkey", "s").to_column("of_epoch"), X.datetime_of("o_orderdate", "clock").to_column("of_date_time"),
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def expr_struct_key(spark, sf):
    grouped = table(spark, sf, "orders").groupBy(X.struct_key("o_orderstatus", "o_orderpriority").to_column("k")).agg(F.count("*").alias("n"))
    return grouped.select("k.o_orderstatus", "k.o_orderpriority", "n")


@query("SELECT o_orderkey, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::BIGINT AS month_index, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def calendar_month_index(spark, sf):
    index = C.month_index("o_orderdate", 1995)
    return table(spark, sf, "orders").select("o_orderkey", index.alias("month_index"), C.index_to_month(index, 1995).alias("month"))


@query("""SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS ts, round(avg(value), 6) AS value, count(value) AS n FROM events GROUP BY 1, 2, 3""")
def stream_tumbling(spark, sf):
    """The streaming form of the tumbling policy, run over a bounded table."""
    from ..streaming.live import tumbling_stream

    return rounded(tumbling_stream(table(spark, sf, "events"), "ts", "value", ["user_id", "event_type"], DAY, DAY))
