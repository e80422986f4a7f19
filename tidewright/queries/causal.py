"""Queries of the matched-control half over ``customer`` and ``orders``: customers are subjects, order months time.

Customers with a key divisible by 5 count as reached, in month 61 + key modulo 3.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..causal import cohort, matching, models, reports
from ..causal.config import Autotune, Campaign, DecileGroups, Points, Study, VolumeGate, Window
from ..functions import calendar as C
from ..functions import windows as W
from ..operators.materialize import cut, shared_dir
from ..sources import generate as G
from .timeseries import rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

STUDY = Study(
    subject="c_custkey", month="m", measures=("spend", "open"),
    windows=(Window("L12M", -11, 0, "last"), Window("PRE06M", -6, -1), Window("PRE12M", -12, -1), Window("TEST01M", 0, 0), Window("POST06M", 1, 6)),
    decile_windows=("L12M",), groups=DecileGroups(((1, 2, 3), (4, 5), (9, 10))), signature=("c_mktsegment", "spend_L12M_decile"),
    categorical=("c_mktsegment",), numeric=("spend_L12M", "open_L12M"), gates=("c_mktsegment",), volume_gates=(VolumeGate("spend_L12M_decile", 1),),
    points=(Points("spend_PRE06M", 2), Points("spend_PRE12M", 1), Points("open_PRE12M", 1)), eligible=("spend_L12M",),
    placebo=("spend_PRE06M", "spend_PRE12M"), placebo_max=1e9, outcomes=("spend_POST06M",), covariates=("open_PRE12M",),
)


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    reached = F.col("c_custkey") % 5 == 0
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", reached.cast("int").alias("reached"), F.when(reached, 61 + F.col("c_custkey") % 3).cast("long").alias("reach_month"), (F.col("c_custkey") % 2).cast("int").alias("called_on"))


def facts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    od = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), C.month_index("o_orderdate", 1995).alias("m"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return {"spend": od.drop("o_orderstatus"), "open": od.where("o_orderstatus = 'O'").drop("o_orderstatus")}


def wide(spark: SparkSession, sf: str) -> DataFrame:
    who = subjects(spark, sf)
    return who.join(cohort.compute_windows(STUDY, who, facts(spark, sf)), "c_custkey")


_SUBJECTS = "s AS (SELECT c_custkey, c_mktsegment, (c_custkey % 5 = 0)::INTEGER AS reached, CASE WHEN c_custkey % 5 = 0 THEN 61 + c_custkey % 3 END AS reach_month, (c_custkey % 2)::INTEGER AS called_on FROM customer)"
_FACTS = "f AS (SELECT o_custkey AS c_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS m, o_totalprice AS value, o_orderstatus FROM orders)"
_ANCHOR = "a AS (SELECT *, coalesce(reach_month, (SELECT min(reach_month) FROM s)) AS ra, (SELECT min(reach_month) FROM s) - 1 AS la FROM s)"


def _sum_sql(measure: str, w: Window) -> str:
    where = "" if measure == "spend" else "o_orderstatus = 'O' AND "
    anchor = "la" if w.anchor == "last" else "ra"
    return f"coalesce(sum(value) FILTER ({where}m - {anchor} BETWEEN {w.low} AND {w.high}), 0)::DOUBLE AS {measure}_{w.name}"


_WINDOWS = ", ".join(_sum_sql(m, w) for m in STUDY.measures for w in STUDY.windows)
_W = f"""WITH {_SUBJECTS}, {_FACTS}, {_ANCHOR},
    w AS (SELECT a.c_custkey, any_value(c_mktsegment) AS c_mktsegment, any_value(reached) AS reached, any_value(called_on) AS called_on, {_WINDOWS} FROM a LEFT JOIN f USING (c_custkey) GROUP BY 1)"""


def _decile_sql(column: str) -> str:
    return f"""CASE WHEN {column} > 0 THEN greatest(least(floor((sum(CASE WHEN {column} > 0 THEN {column} ELSE 0 END) OVER (ORDER BY {column}, c_custkey ROWS UNBOUNDED PRECEDING) - 1e-9::DOUBLE)
        / (sum(CASE WHEN {column} > 0 THEN {column} ELSE 0 END) OVER () / 10)) + 1, 10), 1) ELSE 0 END::BIGINT"""


_D = _W + f", d AS (SELECT *, {_decile_sql('spend_L12M')} AS spend_L12M_decile, {_decile_sql('open_L12M')} AS open_L12M_decile FROM w)"
_BUCKET = "CASE spend_L12M_decile WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 4 WHEN 10 THEN 9 ELSE spend_L12M_decile END"


@query(_W + " SELECT c_custkey, " + ", ".join(f"round({m}_{w.name}, 4) AS {m}_{w.name}" for m in STUDY.measures for w in STUDY.windows) + " FROM w")
def windows_anchored(spark, sf):
    who = subjects(spark, sf)
    at = cohort.anchors(who, "c_custkey", "reach_month")
    frames = [cohort.windowed_sums(facts(spark, sf)[m], at, "c_custkey", "m", "value", m, STUDY.windows) for m in STUDY.measures]
    out = frames[0].join(frames[1], "c_custkey")
    return out.select("c_custkey", *[F.round(c, 4).alias(c) for c in out.columns if c != "c_custkey"])


@query(_D + " SELECT c_custkey, spend_L12M_decile, open_L12M_decile FROM d")
def decile_equal_volume(spark, sf):
    return wide(spark, sf).select("c_custkey", "spend_L12M_decile", "open_L12M_decile")


_TOTAL = "WITH t AS (SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), x AS (SELECT *, least(total / 1000000.0::DOUBLE, 1.0::DOUBLE) AS score FROM t)"


def totals(spark: SparkSession, sf: str) -> DataFrame:
    od = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"))
    df = table(spark, sf, "customer").select("c_custkey").join(od, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))
    return df.withColumn("score", F.least(F.col("total") / 1_000_000.0, F.lit(1.0)))


@query(_TOTAL + " SELECT c_custkey, (floor((row_number() OVER (ORDER BY score, c_custkey) - 1) / count(*) OVER () * 10) + 1)::BIGINT AS bin FROM x")
def decile_equal_count(spark, sf):
    return W.equal_count_bin(totals(spark, sf), "score", "c_custkey", "bin").select("c_custkey", "bin")


@query(_TOTAL + " SELECT c_custkey, CASE WHEN score <= 0 THEN 0 WHEN score >= 1 THEN 10 ELSE greatest(least(ceil(score * 10), 10), 1) END::BIGINT AS bin FROM x")
def bin_equal_range(spark, sf):
    return totals(spark, sf).select("c_custkey", W.equal_range_bin("score", 10).alias("bin"))


@query(_TOTAL + """ SELECT c_custkey, CASE WHEN score > 0 THEN least(floor((count(*) FILTER (score > 0) OVER (ORDER BY score, c_custkey ROWS UNBOUNDED PRECEDING) - 1) * 10 / count(*) FILTER (score > 0) OVER ()) + 1, 10) ELSE 0 END::BIGINT AS bin FROM x""")
def bin_quantile(spark, sf):
    return W.quantile_bin(totals(spark, sf), "score", "c_custkey", "bin", 10).select("c_custkey", "bin")


@query(_D + f" SELECT c_custkey, {_BUCKET}::BIGINT AS bucket FROM d")
def decile_bucket_merge(spark, sf):
    return wide(spark, sf).select("c_custkey", cohort.merged_decile("spend_L12M_decile", STUDY.groups, "spend").cast("long").alias("bucket"))


@query(_D + ", k AS (SELECT DISTINCT c_mktsegment, spend_L12M_decile FROM d WHERE reached = 1) SELECT c_custkey FROM d JOIN k USING (c_mktsegment, spend_L12M_decile)")
def signature_universe(spark, sf):
    return cohort.signature_universe(wide(spark, sf), STUDY.signature, "reached").select("c_custkey")


@query(_D + " SELECT c_mktsegment, spend_L12M_decile, count(*) AS n FROM d WHERE reached = 1 GROUP BY 1, 2")
def signature_counts(spark, sf):
    return cohort.signatures(wide(spark, sf), STUDY.signature, "reached")


_POOLS = _D + f""", e AS (SELECT *, {_BUCKET} AS bucket FROM d WHERE spend_L12M > 0),
    p AS (SELECT t.c_custkey AS test_c_custkey, c.c_custkey AS control_c_custkey, abs(t.spend_PRE06M - c.spend_PRE06M) AS d0, abs(t.spend_PRE12M - c.spend_PRE12M) AS d1, abs(t.open_PRE12M - c.open_PRE12M) AS d2
          FROM e t JOIN e c ON t.reached = 1 AND c.reached = 0 AND t.c_mktsegment = c.c_mktsegment AND abs(t.bucket - c.bucket) <= 1)"""
_MATCH = _POOLS + """, q AS (SELECT *, min(d0) OVER x AS m0, min(d1) OVER x AS m1, min(d2) OVER x AS m2 FROM p WINDOW x AS (PARTITION BY test_c_custkey)),
    r AS (SELECT test_c_custkey, control_c_custkey, CASE WHEN abs(d0 - m0) <= 1e-9 THEN 2.0 ELSE 0.0 END + CASE WHEN abs(d2 - m2) <= 1e-9 THEN 1.0 ELSE 0.0 END + CASE WHEN abs(d1 - m1) <= 1e-9 THEN 1.0 ELSE 0.0 END AS points FROM q),
    b AS (SELECT test_c_custkey, control_c_custkey, points::DOUBLE AS points FROM (SELECT *, row_number() OVER (PARTITION BY test_c_custkey ORDER BY points DESC, control_c_custkey) AS k FROM r) WHERE k = 1)"""


def matched(spark: SparkSession, sf: str):
    rows = cut(wide(spark, sf))
    matches, sizes = matching.match_controls(STUDY, rows)
    return rows, matches, sizes


@query(_POOLS + " SELECT test_c_custkey, count(*) AS pool FROM p GROUP BY 1")
def micropool_gates(spark, sf):
    return matched(spark, sf)[2]


@query(_MATCH + " SELECT test_c_custkey, control_c_custkey, points FROM b")
def match_best_points(spark, sf):
    return matched(spark, sf)[1]


@query(_MATCH + """, z AS (SELECT test_c_custkey, count(*) AS pool FROM p GROUP BY 1)
    SELECT spend_L12M_decile, count(*) AS attempts, count(b.test_c_custkey) AS matched, round(coalesce(avg(pool), 0), 6) AS mean_pool
    FROM e LEFT JOIN z ON z.test_c_custkey = c_custkey LEFT JOIN b ON b.test_c_custkey = c_custkey WHERE reached = 1 GROUP BY 1""")
def match_counts_by_decile(spark, sf):
    rows, matches, sizes = matched(spark, sf)
    tests = matching.eligible(STUDY, rows).where("reached = 1")
    return rounded(matching.match_counts(STUDY, tests, matches, sizes, "spend_L12M_decile"))


def _share_sql(distance: int) -> str:
    return f"""SELECT {distance} AS distance, round(count(*) FILTER (EXISTS (SELECT 1 FROM e c WHERE c.reached = 0 AND c.c_mktsegment = t.c_mktsegment AND abs(c.bucket - t.bucket) <= {distance})) / count(*), 6) AS matched_share FROM e t WHERE t.reached = 1"""


@query(_POOLS + " SELECT * FROM (" + " UNION ALL ".join(_share_sql(d) for d in range(4)) + ") ORDER BY (matched_share >= 0.999) DESC, CASE WHEN matched_share >= 0.999 THEN distance ELSE -distance END LIMIT 1")
def gates_autotuned(spark, sf):
    """The volume gate is relaxed decile by decile, up to 3, until nearly every test has a candidate."""
    rows = cut(wide(spark, sf))
    strict = replace(STUDY, volume_gates=(VolumeGate("spend_L12M_decile", 0),), autotune=Autotune(0.999, (VolumeGate("spend_L12M_decile", 3),)))
    tuned = matching.autotuned(strict, rows)
    ok = matching.eligible(tuned, rows)
    tests, controls = ok.where("reached = 1"), ok.where("reached = 0")
    n, hit = tests.count(), matching.pool_sizes(tuned, tests, controls).count()
    return spark.createDataFrame([(tuned.volume_gates[0].distance, round(hit / n, 6) if n else None)], "distance int, matched_share double")


@query(_MATCH + """ SELECT 'matches' AS file, count(*) AS n_rows FROM b UNION ALL SELECT 'target_list', count(*) FROM s WHERE reach_month IS NOT NULL UNION ALL SELECT 'config', 1 UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'study.toml', 1""")
def export_set(spark, sf):
    """Tables, JSON and a copy of the configuration, all in one folder, read again."""
    rows, matches, _ = matched(spark, sf)
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    listed = reports.target_list(subjects(spark, sf), "c_custkey", "reach_month", 1995, 1, ("c_mktsegment",))
    reports.export(folder, {"matches": matches, "target_list": listed}, {"rows": 1}, {"measures": STUDY.measures}, [], {"study.toml": 'subject = "c_custkey"'})
    counts = [(n, spark.read.csv(f"{folder}/{n}.csv", header=True).count()) for n in ("matches", "target_list")]
    counts += [(n, spark.read.json(f"{folder}/{n}.json", multiLine=True).count()) for n in ("config", "summary")] + [("study.toml", spark.read.text(f"{folder}/study.toml").count())]
    return spark.createDataFrame(counts, "file string, n_rows long")


_PAIRS = _MATCH + ", o AS (SELECT test_c_custkey AS c_custkey, 1 AS treatment FROM b UNION ALL SELECT control_c_custkey, 0 FROM b), pr AS (SELECT o.treatment, w.* FROM o JOIN w USING (c_custkey))"
_PLACEBO = "SELECT '{c}' AS measure, avg({c}) FILTER (treatment = 1) AS t, avg({c}) FILTER (treatment = 0) AS k FROM pr"


@query(_PAIRS + ", g AS (" + " UNION ALL ".join(_PLACEBO.format(c=c) for c in STUDY.placebo) + ") SELECT measure, round(t, 4) AS test_mean, round(k, 4) AS control_mean, round(abs(t - k), 4) AS gap, abs(t - k) <= 1e9 AS passed FROM g")
def placebo_did(spark, sf):
    rows, matches, _ = matched(spark, sf)
    out = matching.placebo(matching.pair_rows(STUDY, matches, rows), STUDY.placebo, STUDY.placebo_max)
    return out.select("measure", *[F.round(c, 4).alias(c) for c in ("test_mean", "control_mean", "gap")], "passed")


@query(f"WITH {_SUBJECTS} SELECT count(*) FILTER (reached = 1) AS n_reached, count(*) FILTER (reached = 0) AS n_control, round(count(*) FILTER (reached = 0) / count(*) FILTER (reached = 1), 6) AS ratio, count(*) FILTER (reached = 1) >= 1 AS passed FROM s")
def input_gates(spark, sf):
    return rounded(cohort.input_gates(STUDY, subjects(spark, sf), "reached"))


_SERIES = """, l AS (SELECT s.c_custkey, CASE WHEN b1.t IS NOT NULL THEN 'test' WHEN b0.c IS NOT NULL THEN 'control' END AS grp FROM s LEFT JOIN (SELECT DISTINCT test_c_custkey AS t FROM b) b1 ON t = s.c_custkey LEFT JOIN (SELECT DISTINCT control_c_custkey AS c FROM b) b0 ON c = s.c_custkey),
    mo AS (SELECT c_custkey, m, sum(value) AS v FROM f GROUP BY 1, 2),
    u AS (SELECT grp, m, v FROM mo JOIN l USING (c_custkey) WHERE grp IS NOT NULL UNION ALL SELECT 'universe', m, v FROM mo),
    ts AS (SELECT 'spend' AS measurement, grp, m AS month, avg(v) AS mean_value, coalesce(stddev_samp(v), 0) AS sd_value, count(v) AS n_value FROM u GROUP BY 2, 3)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    groups = reports.group_labels(matched(spark, sf)[1], "c_custkey")
    return reports.time_series({"spend": facts(spark, sf)["spend"]}, groups, "c_custkey", "m")


@query(_MATCH + _SERIES + ' SELECT measurement, grp AS "group", month, round(mean_value, 4) AS mean_value, round(sd_value, 4) AS sd_value, n_value FROM ts')
def timeseries_groups(spark, sf):
    return series(spark, sf).select("measurement", "group", "month", F.round("mean_value", 4).alias("mean_value"), F.round("sd_value", 4).alias("sd_value"), "n_value")


def _mean_sql(group: str, low: int, high: int) -> str:
    return f"avg(mean_value) FILTER (grp = '{group}' AND month BETWEEN {low} AND {high})"


_DID = {"test_pre": _mean_sql("test", 55, 60), "test_post": _mean_sql("test", 61, 66), "control_pre": _mean_sql("control", 55, 60), "control_post": _mean_sql("control", 61, 66)}


@query(_MATCH + _SERIES + ", x AS (SELECT measurement, " + ", ".join(f"{s} AS {n}" for n, s in _DID.items()) + " FROM ts GROUP BY 1) SELECT measurement, " + ", ".join(f"round({n}, 4) AS {n}" for n in _DID) + ", round((test_post - test_pre) - (control_post - control_pre), 4) AS did, round(((test_post - test_pre) - (control_post - control_pre)) * 100 / control_post, 4) AS did_pct FROM x")
def did_pre_post(spark, sf):
    out = reports.pre_post(series(spark, sf), 61)
    return out.select("measurement", *[F.round(c, 4).alias(c) for c in out.columns if c != "measurement"])


@query(_D + " SELECT spend_L12M_decile, count(*) AS n, count(*) FILTER (reached = 1) AS reached, count(*) FILTER (called_on = 1) AS called FROM d GROUP BY 1")
def funnel_by_decile(spark, sf):
    return reports.decile_funnel(wide(spark, sf), "spend_L12M_decile", {"reached": "reached", "called": "called_on"})


@query(_D + " SELECT spend_L12M_decile, " + ", ".join(f"count(*) FILTER (open_L12M_decile = {k}) AS d{k}" for k in range(11)) + " FROM d GROUP BY 1")
def crosstab_decile(spark, sf):
    return reports.decile_crosstab(wide(spark, sf), "spend_L12M_decile", "open_L12M_decile")


@query(_D + " SELECT spend_L12M_decile, " + ", ".join(f"round(avg(spend_L12M) FILTER (open_L12M_decile = {k}), 4) AS d{k}" for k in range(11)) + " FROM d GROUP BY 1")
def crosstab_decile_volume(spark, sf):
    out = reports.decile_crosstab(wide(spark, sf), "spend_L12M_decile", "open_L12M_decile", "spend_L12M")
    return out.select("spend_L12M_decile", *[F.round(c, 4).alias(c) for c in out.columns if c != "spend_L12M_decile"])


@query(_D + " SELECT called_on, reached, spend_L12M_decile, count(*) AS n FROM d GROUP BY CUBE (called_on, reached, spend_L12M_decile)")
def crosstab_states(spark, sf):
    return reports.state_crosstab(wide(spark, sf), "spend_L12M_decile")


@query(_MATCH + " SELECT c_mktsegment, count(*) AS tests, count(b.test_c_custkey) AS matched, round(count(b.test_c_custkey) / count(*), 6) AS rate FROM d LEFT JOIN b ON b.test_c_custkey = c_custkey WHERE reached = 1 GROUP BY 1")
def match_rate(spark, sf):
    rows, matches, _ = matched(spark, sf)
    return rounded(reports.match_rate(rows.where("reached = 1"), matches, "c_custkey", "c_mktsegment"))


@query(_TOTAL + ", y AS (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM x) SELECT least(floor((score - lo) * 5 / (hi - lo)), 4)::BIGINT AS bin, count(*) AS n FROM y GROUP BY 1")
def score_histogram(spark, sf):
    return reports.score_histogram(totals(spark, sf), "score")


@query("SELECT o_custkey, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def sum_by_subject(spark, sf):
    return reports.sum_by_subject(table(spark, sf, "orders"), "o_custkey", "o_totalprice").select("o_custkey", F.round("total", 4).alias("total"))


@query(_MATCH + " SELECT (SELECT count(*) FROM d) AS subjects, (SELECT count(*) FROM d JOIN (SELECT DISTINCT c_mktsegment, spend_L12M_decile FROM d WHERE reached = 1) USING (c_mktsegment, spend_L12M_decile)) AS in_universe, (SELECT count(*) FROM d WHERE reached = 1) AS reached, count(*) AS matched, count(DISTINCT control_c_custkey) AS controls FROM b")
def waterfall(spark, sf):
    rows, matches, _ = matched(spark, sf)
    inside = cohort.signature_universe(rows, STUDY.signature, "reached").select("c_custkey", F.lit(1).alias("in_universe"))
    return reports.waterfall(rows.join(inside, "c_custkey", "left"), matches, "c_custkey")


@query(f"WITH {_SUBJECTS} SELECT c_custkey, c_mktsegment, strftime(make_date((1995 + (reach_month - 1) // 12)::BIGINT, ((reach_month - 1) % 12 + 1)::BIGINT, 1), '%Y-%m') AS planned_reach_date FROM s WHERE reach_month IS NOT NULL")
def target_list(spark, sf):
    return reports.target_list(subjects(spark, sf), "c_custkey", "reach_month", 1995, 1, ("c_mktsegment",))


@query(_TOTAL + """, y AS (SELECT score, (c_custkey % 5 = 0)::INTEGER AS label, c_custkey FROM x),
    z AS (SELECT *, sum(label) OVER (ORDER BY score DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS tp FROM y)
    SELECT round(sum(CASE WHEN label = 0 THEN tp ELSE 0 END)::DOUBLE / (sum(label)::DOUBLE * (count(*) - sum(label))), 9) AS auc FROM z""")
def auc_trapezoid(spark, sf):
    df = totals(spark, sf).withColumn("label", (F.col("c_custkey") % 5 == 0).cast("int"))
    return W.auc(df, "score", "label", "c_custkey").select(F.round("auc", 9).alias("auc"))


@query("""WITH f AS (SELECT o_custkey AS c_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS m, o_totalprice AS value, o_orderkey FROM orders)
    SELECT o_orderkey, round(value * CASE WHEN c_custkey % 5 != 0 OR m < 61 + c_custkey % 3 THEN 1.0 WHEN m - (61 + c_custkey % 3) < 3 THEN 1 + 0.15::DOUBLE * (m - (61 + c_custkey % 3) + 1) / 3 ELSE 1 + 0.15::DOUBLE END, 4) AS value FROM f""")
def lift_ramp(spark, sf):
    od = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), C.month_index("o_orderdate", 1995).alias("m"), F.col("o_totalprice").alias("value"), "o_orderkey")
    lifted = G.apply_lift(od, subjects(spark, sf), 0.15, 3, "c_custkey", "m")
    return lifted.select("o_orderkey", F.round("value", 4).alias("value"))


_STEPS = 20
_DOT = " + ".join(f"w{k} * x{k}" for k in range(7))


def _z_sql(column: str) -> str:
    return f"({column} - avg({column}) OVER ()) / greatest(stddev_pop({column}) OVER (), 1e-9::DOUBLE)"


_FEATURES = "x AS (SELECT c_custkey, reached::DOUBLE AS y, " + ", ".join(f"(c_mktsegment = '{v}')::DOUBLE AS x{k}" for k, v in enumerate(("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))) + f", {_z_sql('spend_L12M')} AS x4, {_z_sql('open_L12M')} AS x5, 1.0::DOUBLE AS x6 FROM w)"


@query(_W.replace("WITH", "WITH RECURSIVE", 1) + f""", {_FEATURES}, r AS (SELECT 0 AS it, {", ".join(f"0.0::DOUBLE AS w{k}" for k in range(7))}
    UNION ALL SELECT it + 1, {", ".join(f"w{k} - 0.1::DOUBLE * avg((p - y) * x{k})" for k in range(7))} FROM (SELECT r.*, x.*, 1 / (1 + exp(-({_DOT}))) AS p FROM r, x WHERE it < {_STEPS}) GROUP BY it, {", ".join(f"w{k}" for k in range(7))})
    SELECT c_custkey, round(1 / (1 + exp(-({_DOT}))), 9) AS propensity_score FROM x, r WHERE it = {_STEPS}""")
def propensity_gradient_steps(spark, sf):
    """One-hot and standardised features, a fixed number of gradient steps, and everybody's score."""
    rows = cut(wide(spark, sf))
    features = [*models.one_hot(rows, STUDY.categorical), *models.standardised(rows, STUDY.numeric)]
    model = models.fit_logistic(rows, "reached", features, rounds=_STEPS, tolerance=0.0)
    return rows.select("c_custkey", F.round(model.probability(), 9).alias("propensity_score"))


_LOSS = "-avg(y * ln(greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)))"


@query(_W.replace("WITH", "WITH RECURSIVE", 1) + f""", {_FEATURES}, r AS (SELECT 0 AS it, {", ".join(f"0.0::DOUBLE AS w{k}" for k in range(7))}, NULL::DOUBLE AS cost, false AS done
    UNION ALL SELECT it + 1, {", ".join(f"w{k} - 0.1::DOUBLE * avg((p - y) * x{k})" for k in range(7))}, {_LOSS}, coalesce(abs(cost - ({_LOSS})) < 1e-6::DOUBLE, false)
    FROM (SELECT r.*, x.*, 1 / (1 + exp(-({_DOT}))) AS p FROM r, x WHERE it < 200 AND NOT done) GROUP BY it, cost, {", ".join(f"w{k}" for k in range(7))}),
    z AS (SELECT c_custkey, y::INTEGER AS reached, 1 / (1 + exp(-({_DOT}))) AS score FROM x, (SELECT * FROM r ORDER BY it DESC LIMIT 1))
    SELECT c_custkey, reached, round(score, 9) AS propensity_score, (floor((row_number() OVER (ORDER BY score, c_custkey) - 1) / count(*) OVER () * 10) + 1)::BIGINT AS propensity_decile FROM z""")
def propensity_fit_scores(spark, sf):
    """Fitted until the cost rests, and the scores' bins of equal count."""
    rows = cut(wide(spark, sf))
    features = [*models.one_hot(rows, STUDY.categorical), *models.standardised(rows, STUDY.numeric)]
    model = models.fit_logistic(rows, "reached", features)
    scored = rows.select("c_custkey", "reached", model.probability().alias("propensity_score"))
    binned = models.attach_bins(scored, "propensity_score", "c_custkey", "propensity_decile")
    return binned.withColumn("propensity_score", F.round("propensity_score", 9))


def _fit_rows(spark: SparkSession, fit: models.Fit) -> DataFrame:
    rows = [] if fit.beta is None else [(n, float(b), float(s), float(b / s) if s else None) for n, b, s in zip(fit.names, fit.beta, fit.se)]
    return spark.createDataFrame(rows, "term string, beta double, se double, t double")


def _residual_sql(columns: int) -> str:
    """Columns z0.. and y, from each of which the ones before are taken out, one after the other (Gram and Schmidt)."""
    out, last = "", columns - 1
    for i in range(last):
        less = [f"{c} - z{i} * (sum({c} * z{i}) OVER () / sum(z{i} * z{i}) OVER ()) AS {c}" for c in (*(f"z{j}" for j in range(i + 1, columns)), "y")]
        out += f", o{i + 1} AS (SELECT " + ", ".join(less) + f" FROM o{i})"
    return out


@query(_PAIRS + """, o0 AS (SELECT 1.0::DOUBLE AS z0, spend_PRE12M AS z1, open_PRE12M AS z2, (c_mktsegment = 'BUILDING')::DOUBLE AS z3, (c_mktsegment = 'FURNITURE')::DOUBLE AS z4, (c_mktsegment = 'HOUSEHOLD')::DOUBLE AS z5,
    (c_mktsegment = 'MACHINERY')::DOUBLE AS z6, treatment::DOUBLE AS z7, spend_POST06M AS y FROM pr)""" + _residual_sql(8) + """,
    h AS (SELECT sum(y * z7) / sum(z7 * z7) AS beta, sum(z7 * z7) AS zz, sum(y * y) - sum(y * z7) ** 2 / sum(z7 * z7) AS rss, count(*) AS n FROM o7),
    i AS (SELECT avg(spend_POST06M) FILTER (treatment = 1) AS tm, avg(spend_POST06M) FILTER (treatment = 0) AS cm, stddev_samp(spend_POST06M) FILTER (treatment = 1) AS ts, stddev_samp(spend_POST06M) FILTER (treatment = 0) AS cs FROM pr)
    SELECT n, round(beta, 3) AS beta, round(sqrt(rss / (n - 8) / zz), 3) AS se, round(beta / sqrt(rss / (n - 8) / zz), 5) AS t, round(tm, 3) AS test_mean, round(cm, 3) AS control_mean, round(ts, 3) AS test_sd, round(cs, 3) AS control_sd, round((tm - cm) / cm * 100, 5) AS lift_pct FROM h, i""")
def ancova_ols(spark, sf):
    """Effect of treatment on the outcome beside baseline, covariate and dummies, with group means and lift."""
    rows, matches, _ = matched(spark, sf)
    fit = models.ancova(cut(matching.pair_rows(STUDY, matches, rows)), "spend_POST06M", "treatment", "spend_PRE12M", STUDY.covariates, STUDY.categorical)
    beta, se, t = (float(v[1]) for v in (fit.beta, fit.se, fit.t))
    s = fit.stats
    row = (fit.n, round(beta, 3), round(se, 3), round(t, 5), round(s["test_mean"], 3), round(s["control_mean"], 3), round(s["test_sd"], 3), round(s["control_sd"], 3), round(s["lift_pct"], 5))
    return spark.createDataFrame([row], "n long, beta double, se double, t double, test_mean double, control_mean double, test_sd double, control_sd double, lift_pct double")


@query("SELECT 'intercept' AS term, round(regr_intercept(o_totalprice, x), 3) AS beta FROM (SELECT o_totalprice, month(o_orderdate)::DOUBLE AS x FROM orders) UNION ALL SELECT 'x', round(regr_slope(o_totalprice, x), 3) FROM (SELECT o_totalprice, month(o_orderdate)::DOUBLE AS x FROM orders)")
def least_squares_line(spark, sf):
    od = table(spark, sf, "orders").select("o_totalprice", F.month("o_orderdate").cast("double").alias("x"))
    return _fit_rows(spark, models.least_squares(od, "o_totalprice", [("x", F.col("x"))])).select("term", F.round("beta", 3).alias("beta"))


def _who(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """As many made-up subjects as the table of customers has rows."""
    qualities = {"specialty": G.Distribution("categorical", weights={"CARD": 3, "ONC": 1, "GP": 6}), "state": G.Distribution("uniform_choice", weights=dict.fromkeys(("CA", "NY", "TX"), 1.0))}
    n = table(spark, sf, "customer").count()
    return G.subjects(spark, n, qualities, {"rollup": ("specialty", {"CARD": "SPEC", "ONC": "SPEC"})}), n


_SPEC = G.MeasureSpec(G.Distribution("poisson", 4.0), G.Shape("seasonal", 0.2), "payer", {"com": 5, "med": 3, "cash": 2})


@query()
def synth_subjects(spark, sf):
    who, n = _who(spark, sf)
    return G.treat(who, Campaign(targets=n // 4).validated())


@query()
def synth_measurement(spark, sf):
    return G.measurement(_who(spark, sf)[0], _SPEC, 24)


@query("""SELECT count(*) AS subjects, count(*) // 4 AS targets, (count(*) // 4) // 2 AS reached, 0::BIGINT AS off_plan, 14::BIGINT AS first_month, 16::BIGINT AS last_month, true AS months_even, true AS large_ones_first, 0::BIGINT AS wrong_rollups FROM customer""")
def synth_treatment_rules(spark, sf):
    """What every draw of subjects and treatment must keep."""
    who, n = _who(spark, sf)
    rows = cut(G.treat(who, Campaign(targets=n // 4).validated()))
    planned, reached = F.col("planned_reach_month"), F.col("reach_month")
    off = reached.isNotNull() & (reached != planned) | (F.col("reached") != reached.isNotNull().cast("long"))
    wrong = F.col("rollup") != F.when(F.col("specialty") == "GP", "GP").otherwise("SPEC")
    by_month = [F.count_if(planned == m) for m in (14, 15, 16)]
    return rows.agg(
        F.count("*").alias("subjects"), F.count(planned).alias("targets"), F.count(reached).alias("reached"), F.count_if(off).alias("off_plan"), F.min(planned).alias("first_month"), F.max(planned).alias("last_month"),
        (F.greatest(*by_month) - F.least(*by_month) <= 1).alias("months_even"), (F.avg(F.when(planned.isNotNull(), F.col("volume_scale"))) > F.avg(F.when(planned.isNull(), F.col("volume_scale")))).alias("large_ones_first"), F.count_if(wrong).alias("wrong_rollups"),
    )


@query("SELECT count(*) * 24 AS cells, 0::BIGINT AS wrong_sums, 0::BIGINT AS negative FROM customer")
def synth_component_sums(spark, sf):
    """The parts of a split add up to the rounded whole, for every subject and month."""
    who, _ = _who(spark, sf)
    whole = G.measurement(who, G.MeasureSpec(_SPEC.distribution, _SPEC.shape), 24)
    parts = G.measurement(who, _SPEC, 24).groupBy("npi", "mth_cnt").agg(F.sum("value").alias("parts"), F.min("value").alias("least"))
    both = whole.join(parts, ["npi", "mth_cnt"], "full")
    return both.agg(F.count("*").alias("cells"), F.count_if(F.coalesce(F.round("value") != F.col("parts"), F.lit(True))).alias("wrong_sums"), F.count_if(F.col("least") < 0).alias("negative"))


@query("SELECT m AS month_no, 1.0::DOUBLE AS constant, round(greatest(1 - 0.07::DOUBLE * m, 0), 9) AS linear, round(greatest(1 + 0.2::DOUBLE * sin(m * 2 * pi() / 12), 0), 9) AS seasonal FROM range(24) r(m)")
def synth_shapes(spark, sf):
    shapes = {"constant": G.Shape(), "linear": G.Shape("linear", -0.07), "seasonal": G.Shape("seasonal", 0.2)}
    return spark.range(24).select(F.col("id").alias("month_no"), *[F.round(x.factor(F.col("id")), 9).alias(n) for n, x in shapes.items()])


#: Distribution, mean, variance.
_MOMENTS = (
    (G.Distribution("constant", 3.0), 3.0, 0.0), (G.Distribution("uniform", 2.0, 4.0), 3.0, 1 / 3), (G.Distribution("normal", 1.0, 2.0), 1.0, 4.0), (G.Distribution("log_normal", 0.0, 0.5), 1.1331485, 0.3646958),
    (G.Distribution("poisson", 4.0), 4.0, 4.0), (G.Distribution("poisson", 90.0), 90.0, 90.0), (G.Distribution("poisson", 2000.0), 2000.0, 2000.0), (G.Distribution("negative_binomial", 6.0, 3.0), 6.0, 18.0), (G.Distribution("negative_binomial", 2.0, 0.5), 2.0, 10.0), (G.Distribution("bernoulli", 0.3), 0.3, 0.21),
)


@query("SELECT k::INTEGER AS k, true AS mean_fits, true AS variance_fits FROM range(10) r(k)")
def synth_moments(spark, sf):
    """5,000 draws of each distribution have its mean and variance, within five standard errors or 25 %."""
    n, ids = 5_000, spark.range(5_000)
    drawn = ids.select(*[G.numeric(d, 5, ["id"]).cast("double").alias(f"d{k}") for k, (d, _, _) in enumerate(_MOMENTS)])
    cells = []
    for k, (_, mean, variance) in enumerate(_MOMENTS):
        close = F.abs(F.avg(f"d{k}") - mean) <= 5 * (variance / n) ** 0.5 + 1e-9
        cells.append(F.struct(F.lit(k).alias("k"), close.alias("mean_fits"), (F.abs(F.var_samp(f"d{k}") - variance) <= 0.25 * variance + 1e-9).alias("variance_fits")))
    return drawn.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
