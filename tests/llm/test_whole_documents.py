"""op3 deals whole documents, and digests them afterwards."""

import zlib

from tidewright.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def test_sharding_query_deals_whole_documents(spark, monkeypatch):
    dealt, plain = [], sharding.shard_rows
    monkeypatch.setattr(sharding, "shard_rows", lambda df, *a, **b: (dealt.append(df), plain(df, *a, **b))[1])
    got = queries.op3_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(docs.columns) <= set(dealt[0].columns)
    want = sorted((r["doc_id"], len(t) + 1, zlib.crc32(t)) for r in docs.collect() for t in [(r["text"] or "").encode()])
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
