"""Operators without SQL against plain Python: shards, trees, the ordinal likelihood, verdicts, and bounds of the fits."""

import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import gbdt, quality, queries, sharding, toxicity
from tidewright.llm.doc_stats import BASE, FEATURES, document_statistics

SF = "/root/testdata/sf0.001"


def slow_shards(spark, docs, shards, partitions, blocks, seed, keys):
    """The same draws, dealt out with lists and loops."""
    draw = lambda k: F.xxhash64(F.lit(seed + k), *keys).alias(f"d{k}")
    rows = [r.asDict() for r in docs.select("doc_id", *[k.alias(f"k{i}") for i, k in enumerate(keys)], *[draw(k) for k in range(4)]).collect()]
    by_part = defaultdict(list)
    for r in rows:
        by_part[r["d0"] % partitions].append(r)
    n = len(rows)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = sharding.communication_matrix([len(by_part[p]) for p in range(partitions)], sizes, seed)
    cells = defaultdict(list)
    for p, members in by_part.items():
        members.sort(key=lambda r: (r["d1"], r["k0"]))
        dealt = itertools.chain.from_iterable([s] * int(matrix[p, s]) for s in range(shards))
        for r, s in zip(members, dealt):
            cells[s, r["d2"] % blocks].append(r)
    out = []
    for s in range(shards):
        slot = 0
        for b in range(blocks):
            for r in sorted(cells[s, b], key=lambda r: (r["d3"], r["k0"])):
                out.append((r["doc_id"], s, slot))
                slot += 1
    return sorted(out)


def test_sharding_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_sharding(spark, SF).collect()
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = [F.col("doc_id"), F.crc32(data), (F.octet_length(data) + 1).cast("long")]
    want = slow_shards(spark, docs, 16, sharding.PARTITIONS, sharding.BLOCKS, 20240229, keys)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == want
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" for r in got)


def test_matrix_follows_the_whole_law():
    """Every matrix of the sums comes up as often as the multivariate hypergeometric law says (chi-square)."""
    rows, columns, draws = [3, 2, 2], [4, 3], 6000
    law = {}
    for a in itertools.product(*(range(r + 1) for r in rows)):
        if sum(a) == columns[0]:
            law[a] = math.prod(math.comb(r, k) for r, k in zip(rows, a)) / math.comb(sum(rows), columns[0])
    seen = Counter(tuple(int(v) for v in sharding.communication_matrix(rows, columns, seed)[:, 0]) for seed in range(draws))
    assert set(seen) <= set(law) and abs(sum(law.values()) - 1) < 1e-12
    chi = sum((seen[a] - draws * p) ** 2 / (draws * p) for a, p in law.items())
    assert chi < len(law) - 1 + 5 * math.sqrt(2 * (len(law) - 1))


def walk(forest, row):
    """Score of one row, node by node."""
    total = forest.base
    for root in forest.roots:
        k = root
        while forest.left[k] != k:
            k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
        total += forest.value[k]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 4)), 1)  # ties
    return x, ((x[:, 0] < 0.5) & (x[:, 1] > 0.2) | (rng.random(n) < 0.1)).astype(float)


def test_flat_trees_equal_a_walk():
    x, y = sample()
    forest = gbdt.fit(x, y, monotone={0: -1}, trees=12)
    assert np.allclose([walk(forest, r) for r in x], forest.score(x), atol=1e-12)


def test_first_split_is_the_best_of_all():
    x, y = sample()
    forest = gbdt.fit(x, y, trees=1, depth=1)
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = share - y, np.full(len(y), share * (1 - share))
    score = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1.0) / 2
    best = max(score(x[:, f] <= t) + score(x[:, f] > t) for f in range(4) for t in np.unique(x[:, f])[:-1] if 10 <= (x[:, f] <= t).sum() <= len(y) - 10)
    goes = x[:, forest.feature[0]] <= forest.threshold[0]
    assert math.isclose(score(goes) + score(~goes), best)


def test_ordinal_gradient_is_the_numeric_one():
    rng = np.random.default_rng(3)
    x = rng.random((50, 5)) * (rng.random((50, 5)) < 0.6)
    y, share = rng.integers(0, 4, 50), np.full(50, 1 / 50)
    at = np.nonzero(x)
    sparse, params = (*at, x[at]), np.concatenate([rng.normal(size=5), [0.3, -0.2, 0.4]])
    loss = lambda p: toxicity.ordinal_loss(p, sparse, y, 3, share, 0.01)[0]
    grad = toxicity.ordinal_loss(params, sparse, y, 3, share, 0.01)[1]
    step = 1e-6 * np.eye(len(params))
    assert np.allclose(grad, [(loss(params + s) - loss(params - s)) / 2e-6 for s in step], atol=1e-6)
    # Plain products over grades, row by row.
    w, cuts = params[:5], [params[5], params[5] + math.exp(params[6]), params[5] + math.exp(params[6]) + math.exp(params[7])]
    total = 0.0
    for row, grade in zip(x, y):
        above = [1.0, *(1 / (1 + math.exp(-(row @ w - c))) for c in cuts), 0.0]
        total -= math.log(above[grade] - above[grade + 1]) / 50
    assert math.isclose(loss(params), total + 0.005 * (w**2).sum(), rel_tol=1e-9)
    weights, thresholds = toxicity.fit_ordinal(x, y, 3, rounds=3000, rate=0.02, ridge=0.01)
    found = np.concatenate([weights, [thresholds[0]], np.log(np.diff(thresholds))])
    assert np.abs(toxicity.ordinal_loss(found, sparse, y, 3, share, 0.01)[1]).max() < 1e-3


def slow_counts(model, text):
    count = Counter()
    for word in text.lower().split():
        count.update(model.slots[s] for s in toxicity.features_of(word) if s in model.slots)
    return count


def test_toxicity_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.slots) > 0
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        dot = sum(model.weights[f] * math.log1p(n) for f, n in slow_counts(model, (r["text"] or "").encode()).items())
        p = [1 / (1 + math.exp(-max(-30, min(30, dot - t)))) for t in model.thresholds]
        edge = [1.0, *p, 0.0]
        assert math.isclose(got[r["doc_id"]]["expected_severity"], sum(p), rel_tol=1e-9, abs_tol=1e-12)
        assert got[r["doc_id"]]["toxic"] == (p[0] >= 0.5) and got[r["doc_id"]]["grade"] == int(np.argmax([edge[k] - edge[k + 1] for k in range(4)]))


def test_quality_queries_match_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stats = document_statistics(docs).collect()
    features = {r["doc_id"]: list(r["features"]) for r in stats}
    known = sorted((r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in features)
    x, y = np.array([features[i] for i, _ in known]), np.array([q for _, q in known], dtype=float)
    plain = gbdt.fit(x, y)
    scored = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    assert set(scored) == set(features) and len({r["score"] for r in scored.values()}) > 5
    for i, f in features.items():
        assert math.isclose(scored[i]["score"], walk(plain, f), rel_tol=1e-9)
        assert scored[i]["predicted"] == int(scored[i]["score"] >= 0.5) and scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    ruled = gbdt.fit(x, y, {FEATURES.index(f): -1 for f in quality.FALLING})
    kept = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, SF).collect()}
    for r in stats:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        k = kept[r["doc_id"]]
        assert k["base_failed"] == failed and all(k[c] == r[c] for c in BASE)
        assert k["kept"] == (not failed and walk(ruled, r["features"]) >= 0.5)


def test_classifier_holds_on_held_out_rows(spark):
    """Area under the curve over fold 1, which no fit has seen."""
    sf = "/root/testdata/sf0.01"
    scored = queries.op7_quality_classifier(spark, sf).where("held_out")
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null"), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert good and bad
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    print(json.dumps({"held_out_auc": round(auc, 4), "rows": len(rows), "accuracy": round(sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) / len(rows), 4)}))
    assert auc > 0.8


@pytest.fixture(scope="module")
def crowded(spark):
    """One labelled id has 3,000 documents, and its label is repeated."""
    rng = random.Random(8)
    text = lambda k: " ".join(rng.choice(["grumblefex", "w1", "w2", "w3"] if k % 2 else ["w1", "w2", "w3"]) for _ in range(12)) + f" x{k}"
    docs = spark.createDataFrame([(k, text(k)) for k in range(200)] + [(3, text(k)) for k in range(3000)], "doc_id long, text string")
    marks = [(k, k % 2, k % 2) for k in range(200)] + [(3, 1, 1)] * 500
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_fits_collect_no_more_than_their_limit(crowded, monkeypatch):
    docs, labels = crowded
    sizes, plain, ordinal = [], gbdt.fit, toxicity.fit_ordinal
    monkeypatch.setattr(gbdt, "fit", lambda x, y, *a, **b: (sizes.append(len(y)), plain(x, y, *a, **b))[1])
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda x, y, *a, **b: (sizes.append(len(y)), ordinal(x, y, *a, **b))[1])
    assert quality.classify(docs, labels, limit=10).count() == 3200
    assert quality.apply_rules(docs, labels, limit=10).count() == 3200
    toxicity.fit(docs, labels, max_each=10)
    assert len(sizes) == 3 and 0 < sizes[0] <= 10 and 0 < sizes[1] <= 10 and 10 < sizes[2] <= 20


def test_scores_do_not_depend_on_ties_and_repeats(spark, crowded):
    docs, labels = crowded
    some = docs.where("doc_id <> 3")
    long = "w1 grumblefex " * 20_000
    odd = spark.createDataFrame([(None, None), (900, ""), (900, ""), (901, long), (901, long)], "doc_id long, text string")
    a = {(r["doc_id"], r["score"]) for r in quality.classify(some, labels).collect()}
    both = quality.classify(some.unionByName(some).unionByName(odd), labels).collect()
    assert {(r["doc_id"], r["score"]) for r in both if r["doc_id"] is not None and r["doc_id"] < 900} == a
    assert len({r["score"] for r in both if r["doc_id"] == 901}) == 1 and len({r["score"] for r in both if r["doc_id"] in (None, 900)}) == 1


def test_lines_of_a_repeated_id_count_like_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(7, f"shared\nown{k}") for k in range(10)] + [(8, "twice\nb")] * 12 + [(None, f"nobody\n{k}") for k in range(10)] + [(k, "nine") for k in range(20, 29)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_line_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = got.columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op8_line_dedup']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    dropped = {(r["doc_id"], r["n_dropped"]) for r in got.collect()}
    assert (7, 1) in dropped and (8, 0) in dropped and (None, 1) in dropped and (20, 0) in dropped


def test_one_text_copied_very_often_sends_one_text_an_entry(spark, monkeypatch):
    from tidewright.llm import exact_dedup

    copies = spark.range(0, 30_000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("the same text " * 20).alias("text"))
    admitted, plain = [], exact_dedup._admitted
    monkeypatch.setattr(exact_dedup, "_admitted", lambda bits, n: (admitted.append(bits), plain(bits, n))[1])
    got = exact_dedup.exact_groups(copies, largest=True)
    assert got.groupBy("keep_id", "group_size").count().collect() == [(29_999, 30_000, 30_000)]
    narrow = copies.select("doc_id", F.col("text").cast("binary").alias("text"))
    assert narrow.mapInArrow(plain(admitted[0], 32), "doc_id long, digest binary, text binary").count() < 100


def test_runs_leave_a_task(spark, monkeypatch):
    from tidewright.llm import exact_dedup

    index = exact_dedup.MergeIndex(rows=5)
    for k in range(23):
        index.put(b"%032d" % (k % 7), b"%d" % (k % 7), k)
    run, _ = index.leave()
    assert sum(n for _, _, n in run) == 23 and index.leave() == ([], set())
