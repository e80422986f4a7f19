"""Registered queries against their SQL on the smallest tables, a few of each kind."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from tidewright.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
PICKED = (
    "instant_grid_ttl", "sliding_range_avg", "asof_backward_tolerance", "report_month", "upsample_linear", "xsec_rank", "xsec_quantile", "xsec_z_score", "derive_cum_sum", "component_crush_last", "quality_join_filter", "match_best_points", "crosstab_states", "lift_ramp",
    "instant_wide_columns", "instant_string_time", "aligned_to_the_fastest", "aligned_to_the_slowest", "forecast_bounds", "report_empty_buckets", "report_with_synthetic", "synthetic_by_component", "synthetic_where_component", "request_json", "bound_expressions", "source_priority", "policy_checks", "refusals", "schema_json",
    "subset_info", "propensity_gradient_steps", "ancova_ols", "synth_treatment_rules", "decile_equal_volume",
)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_a_grid_request_reads_its_source_once(spark, monkeypatch):
    """Whatever the number of measurements, cells are aggregated from one scan, and all else from the checkpointed cells."""
    from tidewright.operators import materialize
    from tidewright.plans import universe

    cut_plans = []

    def cut(df):
        cut_plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize.cut(df)

    monkeypatch.setattr(universe, "cut", cut)
    for name in ("instant_grid_ttl", "instant_wide_columns"):
        cut_plans.clear()
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert [p.count("FileScan parquet") for p in cut_plans] == [1] and "FileScan" not in plan


def test_an_absent_subpackage_is_passed_over_and_a_broken_one_is_not():
    import __spark_entry__ as entry

    text = open(entry.__file__, encoding="utf-8").read()
    for missing, fails in (("tidewright.llm", False), ("corpus_pipeline", False), ("xxhash", True)):
        gone = ModuleNotFoundError(f"No module named {missing!r}", name=missing)

        def importer(name, *args, real=__import__, gone=gone):
            if name in ("corpus_pipeline", "tidewright.llm"):
                raise gone
            return real(name, *args)

        scope = {"__builtins__": dict(vars(__import__("builtins")), __import__=importer), "__name__": "entry"}
        if fails:
            with pytest.raises(ImportError):
                exec(text, scope)  # noqa: S102
        else:
            exec(text, scope)  # noqa: S102
            assert "instant_grid_ttl" in scope["queries"]() and "pipeline" not in scope["queries"]()
