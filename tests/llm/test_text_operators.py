"""Operators on texts against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import bpe, exact_dedup, line_dedup, mixing, quality, sharding, simhash, toxicity
from tidewright.llm.doc_stats import statistics

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard string, slot string"


def words(n, seed, vocab=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def corpus():
    base = [words(120, k) for k in range(6)]
    near = [b + f" tail{k}" for k, b in enumerate(base[:4])]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate([*base, *near, *base[:3], base[0], base[0]])]
    rows += [(100, None, "en", None), (101, "", None, "s1"), (102, " \t\n ", "de", "s0"), (103, "one two", "de", ""), (104, "one two", "de", ""), (None, "one two", "de", ""), (None, base[5], None, None)]
    rows += [(3, base[3], "en", "s0"), (200, "X" * 5000, "en", "s2"), (201, "é " * 3000, "fr", "s2")]
    return [(i, t, lang, s, 0, "clash", "clash", "clash") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, 0) for k in range(14)] + [(None, 1, 0), (100, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def slow_simhash(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [r["fp"] % (1 << 64) for r in got]
    assert Counter(fps) == Counter(slow_simhash(r[1]) for r in corpus())
    roots = slow_components(fps)
    smallest = {}
    for r, root in zip(got, roots):
        if r["doc_id"] is not None:
            smallest[root] = min(smallest.get(root, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in got] == [smallest.get(root) for root in roots]


@pytest.mark.parametrize("radius", range(7))
def test_links_are_all_pairs_within_the_radius(spark, radius):
    """Crowded buckets too: many fingerprints that share most of their bits."""
    rng = random.Random(radius)
    fps = set()
    for _ in range(5):
        seed = rng.getrandbits(64)
        fps |= {seed} | {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(20)}
    seed = rng.getrandbits(64)
    fps |= {seed ^ k for k in range(60)} | {rng.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1, 1 << 63}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()]
    want = {(a, b) for k, b in enumerate(signed) for a in signed[:k] if bin((a ^ b) % (1 << 64)).count("1") <= radius}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("radius", range(7))
def test_keys_cover_the_radius(radius):
    rng, keys = random.Random(radius), simhash.cover(radius)
    for _ in range(400):
        error = sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 1)))
        assert any(error & keep == flip for keep, flip in keys)


def test_simhash_of_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("largest,digest_bytes", [(True, 32), (False, 32), (True, 1)])
def test_exact_groups_match_brute_force(docs, largest, digest_bytes):
    got = exact_dedup.exact_groups(docs, largest=largest, digest_bytes=digest_bytes).collect()
    groups = defaultdict(list)
    for r in corpus():
        groups[r[1] or ""].append(r[0])
    best = max if largest else min
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert Counter(map(tuple, got)) == Counter(want)


def test_exact_groups_of_empty_table(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_merge_index_agrees_with_a_dictionary():
    rng = random.Random(1)
    index, want = exact_dedup.MergeIndex(rows=7, fanout=3), {}
    for k in range(500):
        text = str(rng.randrange(120)).encode()
        digest = hashlib.sha256(text).digest()
        index.put(digest, text, k)
        old = want.get(digest, (k, 0))
        want[digest] = (min(old[0], k), old[1] + 1)
    assert {d: (i, n) for d, i, n in index.entries()} == want


def test_sharding_is_whole_and_even(docs):
    got = sharding.shard_rows(docs, 5, keys=("doc_id", "text"), partitions=16, blocks=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in corpus())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard_rows(docs.repartition(7), 5, keys=("doc_id", "text"), partitions=16, blocks=4).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_sharding_of_empty_table(nothing):
    assert sharding.shard_rows(nothing, 4, partitions=8, blocks=2).count() == 0


def test_communication_matrix_sums_and_law():
    rows, columns = [5, 0, 9, 3, 4], [7, 7, 7]
    total = sum(sharding.communication_matrix(rows, columns, seed) for seed in range(3000)) / 3000
    m = sharding.communication_matrix(rows, columns, 1)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == columns
    for k, r in enumerate(rows):
        assert abs(total[k] - r / 3).max() < 0.1
    big = sharding.communication_matrix([3 * 10**9, 10**9], [2 * 10**9, 2 * 10**9], 3)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9] and abs(big[0, 0] - 1.5 * 10**9) < 10**6


def bpe_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path())
    own = bpe.WordBpe(bpe_path())
    rng = random.Random(3)
    texts = [r[1] or "" for r in corpus()] + ["", "<|endoftext|>a<|startoftext|>", "ΣΑΣ Éa", "a" * 3000, "lol" * 700, "the cat's"]
    texts += ["".join(rng.choice("aehrtino sldu'.!9é世") for _ in range(rng.randrange(2500))) for _ in range(40)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == ids
        decoder = bpe.token_decoder(own.names)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == lib.decode(ids, skip_special_tokens=False)


def test_bpe_streams_in_constant_memory():
    own = bpe.WordBpe(bpe_path())
    limit = 4 * own.merges.lookahead + 64
    for text in ("abab" * 4000, "the" * 3000, "x" * 9000):
        symbols = [own.vocab[c] for c in text[:-1]] + [own.vocab[text[-1] + "</w>"]]
        pulled = 0

        def feed():
            nonlocal pulled
            for s in symbols:
                pulled += 1
                yield s

        done, worst, tokens = 0, 0, []
        for token in own.merges.stream(feed()):
            tokens.append(token)
            done += own.merges.width[token]
            worst = max(worst, pulled - done)
        assert tokens == own.merges.tokens(list(symbols)) and worst <= limit


def test_byte_decoder_holds_back_parts_of_a_character():
    alphabet = bpe.byte_alphabet()
    names = {k: alphabet[b] for k, b in enumerate("é世".encode())}
    decoder = bpe.byte_decoder(names)
    assert [decoder.feed([k]) for k in range(5)] == ["", "é", "", "", "世"]
    assert decoder.feed([0]) == "" and decoder.finish() == "�"


def test_bpe_rows(docs, nothing):
    rows = bpe.encode_documents(docs, bpe_path(), with_ids=True).collect()
    assert len(rows) == len(corpus()) and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    empty = [r for r in rows if r["doc_id"] in (100, 101, 102)]
    assert all(r["n_tokens"] == 0 and r["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    assert bpe.encode_documents(nothing, bpe_path()).count() == 0


def slow_statistics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)]


def test_statistics_match_brute_force():
    rng = random.Random(2)
    texts = [r[1] or "" for r in corpus()] + ["a b c d e a b c d e", "x x x x x x", "a\na\n\n a\n", "#*$%&|<> é世\x1f"]
    texts += ["".join(rng.choice("ab \n#é\x0b") for _ in range(rng.randrange(300))) for _ in range(60)]
    for t in texts:
        assert statistics(t.encode())[0] == slow_statistics(t)


def test_forest_is_monotonic_and_flat():
    import numpy as np

    from tidewright.llm import gbdt

    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] + 0.4 * rng.standard_normal(3000) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    forest = gbdt.fit(x, y, monotone={0: -1})
    grid = np.repeat(rng.random((50, 4)), 60, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 60), 50)
    assert (np.diff(forest.score(grid).reshape(50, 60), axis=1) <= 1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.8
    assert gbdt.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_without_labels_and_on_nothing(docs, nothing, labels):
    rows = quality.classify(docs, labels.limit(0)).collect()
    assert len(rows) == len(corpus()) and {r["score"] for r in rows} == {0.5}
    held = {r["doc_id"]: r["held_out"] for r in rows}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    ruled = quality.apply_rules(docs, labels).collect()
    assert all(r["base_failed"] for r in ruled if r["doc_id"] in (100, 101, 102, 103))
    assert quality.apply_rules(nothing, labels).count() == 0 and quality.classify(nothing, labels).count() == 0


def test_mixing_against_plain_arithmetic(docs, nothing):
    got = mixing.copies(docs).collect()
    assert len(got) == len(corpus()) and nothing is not None
    size = Counter()
    for r in corpus():
        size[r[3]] += len((r[1] or "").encode().split())
    assert {r["source"]: r["source_size"] for r in got} == dict(size)
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, full = {}, 1.5 * sum(size.values()), set()
    while True:
        share = left / max(1, sum(w for s, w in weight.items() if s not in full))
        over = {s for s in weight if s not in full and share * weight[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        full |= over
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
    target = {s: 2.0 * size[s] if s in full else share * weight[s] for s in weight}
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in target.items()}
    taken = Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in size:
        assert abs(taken[s] - target[s]) <= max((r["size"] for r in got if r["source"] == s), default=0)
    assert sorted(map(str, mixing.copies(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.copies(nothing).count() == 0


def slow_lines(texts, min_docs):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
    seen = defaultdict(set)
    for k, t in enumerate(texts):
        for line in t.split("\n"):
            seen[key(line)].add(k)
    gone = {x for x, ks in seen.items() if len(x) >= 1 and len(ks) >= min_docs}
    return ["\n".join(x for x in t.split("\n") if key(x) not in gone) for t in texts]


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_match_brute_force(spark, parts):
    rng = random.Random(parts)
    texts = ["\n".join(rng.choice(["Common ", "common", "COMMON\t", "rare%d" % rng.randrange(400), "mid%d" % rng.randrange(12), "", " "]) for _ in range(rng.randrange(9))) for _ in range(150)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(900, None, 1)], "doc_id long, text string, n_lines int").repartition(5)
    maps = line_dedup.keep_bitmaps(df)
    got = {r["doc_id"]: r for r in line_dedup.apply_bitmaps(df, maps).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = slow_lines(texts, 10)
    assert [got[k]["text"] for k in range(len(texts))] == want
    assert all(got[k]["n_lines"] == t.count("\n") + 1 for k, t in enumerate(texts))
    assert got[900]["text"] is None and got[900]["n_lines"] == 1 and got[900]["n_dropped"] == 0


def test_lines_keep_first(spark):
    rows = [(k, "shared\nown%d\nshared" % k) for k in range(5)] + [(2, "shared\nown2\nshared")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, min_docs=2, keep_first=True)).collect()
    texts = [r["text"] for r in got]
    assert len(got) == 6 and sum("shared" in t for t in {(r["doc_id"], r["text"]): r["text"] for r in got}.values()) == 1
    assert all("own" in t for t in texts)


def test_lines_of_empty_table(nothing):
    assert line_dedup.keep_bitmaps(nothing).count() == 0


def test_bitmap_round_trip():
    import numpy as np

    for n in (0, 1, 8, 1000):
        keep = np.random.default_rng(n).random(n) < 0.5
        assert (line_dedup.expand(line_dedup.compress(keep)) == keep).all()


def test_toxicity_learns_and_takes_anything(spark, docs, nothing):
    rng = random.Random(9)
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.randrange(1, 6) * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["grumblefex", "Snarkwit!", "vilemoth"]))
        rows.append((k, " ".join(w), "x"))
        marks.append((k, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    got = toxicity.severity(df, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    hit = got.where(F.col("label").isNotNull()).agg(F.avg((F.col("toxic") == (F.col("label") == 1)).cast("double"))).first()[0]
    assert hit > 0.97
    assert toxicity.severity(docs, model).count() == len(corpus())
    assert not any(r["toxic"] for r in toxicity.severity(docs.where("doc_id in (100, 101)"), model).collect())
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.severity(df, none).where("toxic").count() == 0
    assert toxicity.severity(nothing, model).count() == 0 and toxicity.fit(nothing, labels).slots == {}
