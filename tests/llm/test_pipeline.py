"""The pipeline's stages on their own input, and the registered queries' columns."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0)], docs.schema)
    return docs.unionByName(odd)


def test_stages_keep_columns_and_take_effect(spark, inputs):
    docs = inputs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, docs, SF)
        assert set(out.columns) == set(inputs.columns), name
        if name == "line_dedup":
            assert out.count() == docs.count()
        if name == "simhash_near_dedup":
            assert out.count() < docs.count() and out.count() == out.distinct().count()
        docs = out
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_stages_take_clashing_columns_long_texts_nulls_and_ties(spark):
    """Each stage on a table with columns of its own names for things; the result is that of the plain table."""
    long = " ".join(f"w{k % 997} x{k % 13}" for k in range(20_000))
    rows = [(k, f"line {k}\nshared words of all\nword{k} " * 3, "en", f"s{k % 3}", 10) for k in range(14)]
    rows += [(50, long, "en", "s0", 1), (51, long + " tail", "en", "s1", 1), (52, None, "en", None, None), (53, "", "en", "s1", 0), (53, "", "en", "s1", 0), (None, "a few words here", None, "s2", 1), (54, "\n \n", "de", "s2", 3)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("__key", "__copy", "__copies", "__s", "__doc", "__rank", "toxic", "grade", "size", "copies", "fp", "root", "component_id", "n_lines", "n_dropped", "bitmap", "part", "h", "skey", "ids")
    odd = plain.withColumns({c: F.lit("clash") for c in names})
    for name, stage in pipeline.STAGES:
        a, b = stage(spark, plain, SF), stage(spark, odd, SF)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
        if name == "line_dedup":
            got = {r["doc_id"]: r["text"] for r in a.where("doc_id < 53").collect()}
            assert got[52] is None and got[50] == long and "shared words of all" not in got[3]
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in a.collect()]
            assert {50, 52} <= {*ids} and not {51, 53, 54} & {*ids}  # texts without words are one group


def test_stages_take_an_empty_table(spark, inputs):
    for _, stage in pipeline.STAGES:
        assert stage(spark, inputs.limit(0), SF).count() == 0


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg(F.sum("n_tokens")).first()[0] > 0
