"""The matched-control half: formulas against numpy, and recovery of an injected lift."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.causal import cohort, matching, models
from tidewright.causal.config import Autotune, Campaign, Points, Study, VolumeGate, Window
from tidewright.causal.pipeline import Raw
from tidewright.errors import ConfigError
from tidewright.functions import windows as W
from tidewright.sources import generate as G


def test_equal_volume_and_count_bins(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0, 0, 1, 1, 2, 4, 8, 16, 32, 64])] + [(99, None)], "k int, v double")
    got = {r.k: r.d for r in W.equal_volume_decile(df, "v", "k", "d").collect()}
    cum, total = 0.0, 128.0
    for k, v in enumerate([0, 0, 1, 1, 2, 4, 8, 16, 32, 64]):
        cum += v
        assert got[k] == (0 if v <= 0 else min(10, max(1, int((cum - 1e-9) // (total / 10)) + 1)))
    assert got[99] == 0
    hundred = spark.range(100).select("id", (F.col("id") / 100).alias("s"))
    assert {r["count"] for r in W.equal_count_bin(hundred, "s", "id", "b").groupBy("b").count().collect()} == {10}
    assert {r.b: r["count"] for r in W.quantile_bin(hundred, "s", "id", "b", 3).groupBy("b").count().collect()} == {0: 1, 1: 33, 2: 33, 3: 33}


def test_auc(spark):
    rng = np.random.default_rng(0)
    y = rng.random(300) < 0.4
    s = np.round(rng.random(300) + 0.3 * y, 2)
    df = spark.createDataFrame([(k, float(a), int(b)) for k, (a, b) in enumerate(zip(s, y))], "k int, s double, y int")
    order = sorted(range(300), key=lambda k: (-s[k], k))
    tp = area = 0
    for k in order:
        tp, area = tp + y[k], area + (0 if y[k] else tp)
    assert W.auc(df, "s", "y", "k").first()[0] == pytest.approx(area / (y.sum() * (~y).sum()))
    assert W.auc(df.where("y = 1"), "s", "y", "k").first()[0] is None


def test_logistic_takes_the_same_steps_either_way(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(200)
    df = spark.createDataFrame([(float(a), int(a + 0.3 * b > 0)) for a, b in zip(x, rng.standard_normal(200))], "x double, y int")
    near = models.fit_logistic(df, "y", [("x", F.col("x"))], rounds=8)
    far = models.fit_logistic(df, "y", [("x", F.col("x"))], rounds=8, driver_rows=0)
    assert near.iterations == far.iterations and np.allclose(near.weights, far.weights) and near.weights[0] > 0
    assert df.select(near.probability().alias("p")).where("p <= 0 or p >= 1").count() == 0


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 2))
    y = 1 + x @ [2, -3] + 0.1 * rng.standard_normal(80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    fit = models.least_squares(df, "y", [("a", F.col("a")), ("b", F.col("b"))])
    full = np.column_stack([np.ones(80), x])
    beta, rss, *_ = np.linalg.lstsq(full, y, rcond=None)
    assert np.allclose(fit.beta, beta) and np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rss[0] / 77))
    assert "depend" in models.least_squares(df, "y", [("a", F.col("a")), ("c", 2 * F.col("a"))]).skipped
    assert models.least_squares(df.limit(2), "y", [("a", F.col("a"))]).skipped


def test_draws_have_their_moments(spark):
    df = spark.range(4000)
    mean = lambda d, scale=None: df.select(G.numeric(d, 5, ["id"], scale).alias("v")).agg(F.avg("v"), F.var_samp("v")).first()
    assert mean(G.Distribution("constant", 3.0))[0] == 3.0
    m, v = mean(G.Distribution("poisson", 4.0))
    assert abs(m - 4) < 0.15 and abs(v - 4) < 0.4
    m, v = mean(G.Distribution("negative_binomial", 6.0, 3.0))
    assert abs(m - 6) < 0.4 and v > 12
    m, v = mean(G.Distribution("normal", 1.0, 2.0))
    assert abs(m - 1) < 0.15 and abs(v - 4) < 0.4
    shares = df.select(G.choice({"a": 1, "b": 3}, G.unit(1, "id")).alias("c")).where("c = 'b'").count() / 4000
    assert abs(shares - 0.75) < 0.03


def test_components_are_split_within_their_row(spark):
    """The parts add up to the rounded whole, and no row is shuffled to count them."""
    who = G.subjects(spark, 50, {})
    spec = G.MeasureSpec(G.Distribution("poisson", 20.0), component="c", levels={"a": 1, "b": 2})
    parts = G.measurement(who, spec, 6)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    whole = {(r[0], r[1]): r[2] for r in G.measurement(who, G.MeasureSpec(spec.distribution), 6).collect()}
    rows = parts.collect()
    assert len({(r.npi, r.mth_cnt, r.c) for r in rows}) == len(rows)
    sums = {}
    for r in rows:
        sums[r.npi, r.mth_cnt] = sums.get((r.npi, r.mth_cnt), 0) + r.value
    assert set(sums) == set(whole) and all(abs(sums[k] - v) <= 0.5 for k, v in whole.items())


def test_the_study_recovers_a_lift(spark, tmp_path):
    campaign = Campaign(targets=300, reach_share=0.6).validated()
    qualities = {"specialty": G.Distribution("categorical", weights={"CARD": 1, "GP": 2})}
    who = G.treat(G.subjects(spark, 1200, qualities), campaign).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else G.treat(G.subjects(spark, 1200, qualities), campaign)
    spec = G.MeasureSpec(G.Distribution("constant", 10.0))
    facts = {m: G.measurement(who, spec, 24, noise=0.1, seed=40 + k) for k, m in enumerate(("brx", "hrx"))}
    facts["brx"] = G.apply_lift(facts["brx"], who, 0.5, 1)
    study = Study(
        measures=("brx", "hrx"), windows=(Window("L12M", -11, 0, "last"), Window("PRE06M", -6, -1), Window("PRE12M", -12, -1), Window("POST06M", 1, 6)), decile_windows=("L12M",),
        categorical=("specialty",), numeric=("brx_L12M", "hrx_L12M"), gates=("specialty",), volume_gates=(VolumeGate("brx_L12M_decile", 1),), points=(Points("brx_PRE12M", 2), Points("brx_PRE06M", 1)),
        eligible=("brx_L12M",), placebo=("brx_PRE06M",), placebo_max=10.0, outcomes=("brx_POST06M",), covariates=("hrx_PRE12M",),
    )
    done = Raw(study, who, facts).windowed().scored().matched().estimated()
    fit = done.fits[0]
    assert fit.skipped is None and fit.n > 200 and fit.t[1] > 5
    assert 35 < 100 * fit.beta[1] / fit.stats["control_mean"] < 65
    done.export(str(tmp_path / "out"), configs={"campaign.toml": "[campaign]\ntargets = 300\n"})
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert {"subjects.csv", "windows.csv", "matches.csv", "timeseries.csv", "summary.json", "ancova.json", "config.json", "target_list.csv", "cfg-parsed.json", "campaign.toml"} <= names
    with pytest.raises(ConfigError):
        cohort.require_inputs(Study(min_reached=10**6), who, "reached")


def slow_matches(study, rows):
    """Every pair of a pool, one by one."""
    near = lambda a, b, d: a is not None and b is not None and abs(a - b) <= d
    out, sizes = {}, {}
    for t in (r for r in rows if r["reached"]):
        pool = [c for c in rows if not c["reached"] and c["seg"] is not None and c["seg"] == t["seg"] and near(t["a_decile"], c["a_decile"], 1)]
        if not pool:
            continue
        points = {c["id"]: 0.0 for c in pool}
        for p in study.points:
            gaps = {c["id"]: abs(t[p.column] - c[p.column]) for c in pool if t[p.column] is not None and c[p.column] is not None}
            for i, g in gaps.items():
                points[i] += p.points * (g <= min(gaps.values()) + 1e-9)
        best = max(points.values())
        out[t["id"]], sizes[t["id"]] = (min(i for i, x in points.items() if x == best), best), len(pool)
    return out, sizes


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_matches_equal_all_pairs(spark, seed):
    """Ties, values a rounding error apart, nulls, and one cell with most rows."""
    rng = np.random.default_rng(seed)
    pick = lambda: None if rng.random() < 0.1 else float(rng.choice([0, 0, 0, 1, 1 + 4e-10, 2.5, -3, 1e6, 1e6 + 1e-4, round(rng.random() * 10, 2)]))
    rows = [{"id": k, "reached": int(rng.random() < 0.3), "seg": None if rng.random() < 0.05 else str(rng.choice(["x", "x", "x", "y", "z"])), "a_decile": None if rng.random() < 0.05 else int(rng.integers(0, 4)), "a_one": pick(), "a_two": pick(), "b_one": pick()} for k in range(150)]
    study = Study(subject="id", measures=("a", "b"), gates=("seg",), volume_gates=(VolumeGate("a_decile", 1),), points=(Points("a_one", 2), Points("a_two", 1), Points("b_one", 1)))
    df = spark.createDataFrame(rows, "id int, reached int, seg string, a_decile int, a_one double, a_two double, b_one double").repartition(5)
    want, sizes = slow_matches(study, rows)
    matches, pools = matching.match_controls(study, df)
    assert {r["test_id"]: (r["control_id"], r["points"]) for r in matches.collect()} == want
    assert {r["test_id"]: r["pool"] for r in pools.collect()} == sizes
    pairs = matching.micropools(study, df.where("reached = 1"), df.where("reached = 0"))
    assert {r["test_id"]: r["count"] for r in pairs.groupBy("test_id").count().collect()} == sizes
    assert matching.match_controls(study, df.limit(0))[0].count() == 0


def _most_rows(df):
    """Rows out of the largest step of a plan that has run."""
    def walk(node):
        metric = node.metrics().get("numOutputRows")
        children = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *[walk(children.apply(i)) for i in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_tied_controls_are_looked_up_not_paired(spark, monkeypatch):
    study = Study("id", "m", ("a", "b"), gates=("g",), points=(Points("a", 1), Points("b", 1)))
    tests, controls = (spark.range(start, start + 400).select("id", F.lit("x").alias("g"), (F.col("id") * 7.25).alias("a"), F.lit(0.0).alias("b")) for start in (0, 1000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        best = matching.best_matches(study, tests, controls)
        got = {tuple(r) for r in best.collect()}
        assert _most_rows(best) < 400 * 20
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {(k, 1000, 2.0) for k in range(400)}  # the nearest in both columns is the first control for every test
    monkeypatch.setattr(matching, "SETS", 1)
    assert {tuple(r) for r in matching.best_matches(study, tests, controls).collect()} == got


def test_gates_are_relaxed_until_enough_match(spark):
    df = spark.createDataFrame([(k, int(k < 10), "x", k % 10 if k < 10 else 0) for k in range(20)], "id int, reached int, seg string, a_decile int")
    tuned = lambda target, most: matching.autotuned(Study(subject="id", gates=("seg",), volume_gates=(VolumeGate("a_decile", 0),), autotune=Autotune(target, (VolumeGate("a_decile", most),))), df).volume_gates[0].distance
    assert tuned(0.1, 9) == 0 and tuned(0.5, 9) == 4 and tuned(1.0, 3) == 3
    with pytest.raises(ConfigError):
        matching.autotuned(Study(subject="id", gates=("seg",), autotune=Autotune(1.0, (VolumeGate("nope", 1),))), df)


def test_toml_configuration(tmp_path):
    from tidewright.causal.config import load

    (tmp_path / "a.toml").write_text('subject = "npi"\n')
    (tmp_path / "b.toml").write_text('[campaign]\nstart = "2024-01"\nreach_start = "2025-02"\ntargets = 10\n')
    (tmp_path / "c.toml").write_text('[study]\nmeasures = ["brx"]\ngates = ["state"]\n[[study.windows]]\nname = "PRE03M"\nlow = -3\nhigh = -1\n[study.groups]\ndefault = [[1, 2], [3]]\n')
    schema, campaign, study = load(*(str(tmp_path / f"{x}.toml") for x in "abc"))
    assert schema["subject"] == "npi" and campaign.targets == 10 and study.windows == (Window("PRE03M", -3, -1),) and study.groups.mapping("brx") == {1: 1, 2: 1, 3: 3}
