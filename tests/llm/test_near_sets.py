"""Near copies against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import near_sets, simhash

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Pairs at 0.8 or more, and the component of each text."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i, j in combinations(range(len(sets)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            pairs.append((i, j))
            root[max(find(i), find(j))] = min(find(i), find(j))
    return pairs, [find(k) for k in range(len(texts))]


def corpus():
    rng = random.Random(11)
    texts = [None, "", " \t ", "a b c", "A  b c", "one two three four five"]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    base = [f"v{k}" for k in range(150)]  # a family too large for pairs
    for k in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


def partition(names):
    found = {}
    for k, x in enumerate(names):
        found.setdefault(x, set()).add(k)
    return {frozenset(v) for v in found.values()}


@pytest.mark.parametrize("limit,block", [(8, 200), (2, 10), (100, 200)])
def test_components_match_brute_force(spark, limit, block):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("k", F.col("doc_id"))
    got = {r["doc_id"]: r["root"] for r in near_sets.near_copies(docs, "k", limit, block).collect()}
    assert partition([bytes(got[k]) for k in range(len(texts))]) == partition(brute(texts)[1])


def test_recall_on_the_test_tables(spark):
    """Over all pairs of the smallest table; two bits of SimHash miss most of those that are no copies."""
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().collect()]
    pairs, _ = brute(texts)
    pairs = [(i, j) for i, j in pairs if grams(texts[i]) != grams(texts[j])]
    keys = [set(near_sets.bands(near_sets.shingles(t.encode())).tolist()) for t in texts]
    assert pairs and all(keys[i] & keys[j] for i, j in pairs)
    far = [(simhash.simhash(texts[i].encode()) ^ simhash.simhash(texts[j].encode())).bit_count() for i, j in pairs]
    assert any(d > 2 for d in far)


def test_stage_drops_near_copies_beyond_two_bits(spark):
    texts = corpus()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    kept = pipeline.stage_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)[1]))


def plain_simhash(text):
    """The first bits of the SimHash, shingle by shingle."""
    found, bits, mask = near_sets.shingles(text.encode()).tolist(), [], (1 << 64) - 1
    for flip, odd, mix in list(zip(*(x.tolist() for x in (near_sets._MASKS, near_sets._ODD, near_sets._MIX))))[: near_sets.PRINT]:
        ones = [0] * 64
        for h in found:
            h = (h ^ flip) * odd & mask
            h = (h ^ h >> 32) * mix & mask
            h ^= h >> 29
            ones = [n + (h >> b & 1) for b, n in enumerate(ones)]
        bits += [2 * n > len(found) for n in ones]
    return bits


@pytest.mark.parametrize("words", [1, 4, 5, 19, 64, 245, 1000])
def test_simhash_matches_plain_counts(words):
    text = " ".join(f"w{k}" for k in range(words))
    kept, simhash = near_sets.sketch(near_sets.shingles(text.encode()))
    assert [bool(x >> b & 1) for x in simhash for b in range(64)] == plain_simhash(text)
    keys = near_sets.keys_of(kept).tolist()
    assert len(set(keys)) == len(keys) == 4 * near_sets.SEGMENTS


def test_stage_links_by_simhash(spark, monkeypatch):
    """Without a radius no two different fingerprints link; copies of one set of shingles stay copies."""
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*base[:-1], x]), "en", "s", 1) for k, x in enumerate(("a", "b", "c", "A"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [r["doc_id"] for r in pipeline.stage_near_dedup(spark, docs, "").collect()] == [0]
    monkeypatch.setattr(near_sets, "RADIUS", -1)
    assert sorted(r["doc_id"] for r in pipeline.stage_near_dedup(spark, docs, "").collect()) == [0, 1, 2]


def test_keys_find_random_pairs_at_the_threshold():
    """At a similarity of 0.8 exactly, the least that links; for sets of 10 and 1000 shingles."""
    rng = np.random.default_rng(7)
    for common, own, runs in ((8, 1, 500), (800, 100, 100)):
        found = 0
        for _ in range(runs):
            x = rng.integers(0, 1 << 64, size=common + 2 * own, dtype=np.uint64)
            (a, p), (b, q) = near_sets.sketch(x[: common + own]), near_sets.sketch(np.delete(x, slice(common, common + own)))
            differ = sum(((u ^ v) & ((1 << 64) - 1)).bit_count() for u, v in zip(p, q))
            found += bool(np.intersect1d(near_sets.keys_of(a), near_sets.keys_of(b)).size) and differ <= near_sets.RADIUS
        assert found >= 0.99 * runs
