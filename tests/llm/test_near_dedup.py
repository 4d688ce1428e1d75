import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.llm import near_dedup as nd
from quernstone.llm.bytewise import chunks
from quernstone.llm.components import components

VOCABULARY = [f"w{i}" for i in range(3000)]


def _groups(rows):
    return {r.doc_id: r.class_id for r in rows}


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _brute(docs):
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {i: _shingles(t) for i, t in docs}
    for i, _ in docs:
        for j, _ in docs:
            if i < j and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in docs}


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    docs = []
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    for k in range(40):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(3, 150))]
        if k % 2:
            words += passage  # many documents share it
        docs.append(words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, len(copy) // 120, len(copy) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            docs.append(copy)
    base = [rng.choice(VOCABULARY) for _ in range(200)]
    for _ in range(40):  # a large group of near copies, above the size up to which all pairs are tried
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(VOCABULARY)
        docs.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert _groups(found) == _brute(rows)
    sizes = {}
    for r in found:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] for r in found)


def test_copies_near_only_to_their_original(spark):
    rng = random.Random(11)
    base = [rng.choice(VOCABULARY) for _ in range(250)]
    docs = [base]
    for _ in range(200):  # about 0.85 like the original, 0.72 like each other
        copy = list(base)
        for k in rng.sample(range(4, 246), 4):
            copy[k] = rng.choice(VOCABULARY)
        docs.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert _groups(found) == _brute(rows) == {i: 0 for i in range(201)}


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    test_copies_near_only_to_their_original(spark)


def test_dense_sets_just_under_the_threshold(spark):
    """Three sets of 300 texts that share a passage: in each 150 pairs at 0.812, every other pair at 0.78."""
    rows = []
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        some = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]  # noqa: B023, E731
        passage = some(190)
        for _ in range(150):
            common = some(4)
            rows += [(len(rows) + k, " ".join(passage + common + some(22))) for k in (0, 1)]
    want = _brute(rows)
    assert len(set(want.values())) == 450
    assert _groups(nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == want


def test_pairs_are_compared_in_one_band_only():
    """Every pair that meets in a bucket is a candidate in exactly one of the buckets that it shares, whatever the blocks."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**32, nd.SLOTS, dtype=np.uint32)
    sig = np.where(rng.random((60, nd.SLOTS)) < 0.12, rng.integers(1, 2**32, (60, nd.SLOTS), dtype=np.uint32), base)
    keys = nd.band_keys(sig).view(np.int64)
    agree = [(a, b) for a in range(60) for b in range(a + 1, 60) if (sig[a] == sig[b]).mean() >= nd.AGREE and a % 7 != b % 7 and (keys[a] == keys[b]).any()]
    seen = []
    for band in np.unique(keys):
        rows = np.flatnonzero((keys == band).any(1))
        for i, j in ((0, 0), (0, 1), (1, 1)):
            own = rows[(rows % 2 == i) | (rows % 2 == j)]
            if not len(own):
                continue
            table = pa.table({"band": np.full(len(own), band), "tk": own, "group": own % 7, "block": own % 2, "i": np.full(len(own), i), "j": np.full(len(own), j), "sig": [sig[r].tobytes() for r in own]})
            _, x, y = nd._pairs(table)
            seen += [tuple(sorted((own[a], own[b]))) for a, b in zip(x, y, strict=True)]
            assert sorted(nd._needed(table)["tk"].to_pylist()) == sorted({int(own[k]) for k in np.append(x, y)})
    assert sorted(seen) == agree and len(agree) > 500


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        keys = rng.integers(0, 2**44, 300, dtype=np.uint64)
        a, b = np.sort(keys[:200]), np.sort(keys[60:260])
        wa, wb = 1 + rng.random(200), 1 + rng.random(200)
        sig = nd.signatures(np.repeat([0, 1], 200), np.concatenate([a, b]), np.concatenate([wa, wb]), 2)
        errors.append((sig[0] == sig[1]).mean() - nd.probability_jaccard(a, wa, b, wb))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_probability_jaccard_is_jaccard_for_equal_weights():
    a, b = np.arange(10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)
    assert abs(nd.probability_jaccard(a, np.ones(10), b, np.ones(10)) - 5 / 15) < 1e-12
    assert abs(nd.probability_jaccard(a, np.ones(10), a, 7 * np.ones(10)) - 1) < 1e-12


def test_short_and_long_signature():
    t = next(chunks(pa.array(["one", "", "one", "two words"])))
    doc, s, w = nd.shingles(t)
    assert doc.tolist() == [0, 2, 3] and s[0] == s[1] != s[2]
    sig = nd.signatures(doc, s, w, 4)
    assert (sig[0] == sig[2]).all() and not sig[1].any() and (sig[0] != sig[3]).all()


def test_odd_rows(spark, odd, nothing):
    found = nd.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.class_id)
    assert by[5] == [5, 5] and by[6] == [5] and by[None] == [None] and by[1] == [1] and by[2] == [2]
    kept = nd.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert nd.near_duplicates(nothing).count() == 0 and nd.keep_one(nothing).count() == 0


def test_rows_are_kept_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (7, c, 3), (7, a, 4), (3, a, 5), (3, a, 6), (None, a, 7), (9, None, 8)]
    for kind in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int").withColumn("doc_id", F.col("doc_id").cast(kind))
        kept = nd.keep_one(docs).collect()
        assert sorted(r.row for r in kept if r.row not in (5, 6)) == [2, 3, 7, 8] and sum(r.row in (5, 6) for r in kept) == 1


def test_texts_that_share_a_key_by_chance(spark):
    signed = spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 11, 7)], "doc_id bigint, tk bigint, check bigint")
    clashes = spark.createDataFrame([(10, True)], "tk bigint, clash boolean")
    keys = {r.doc_id: r.tk for r in nd._told_apart(signed, clashes).collect()}
    assert keys[3] == 11 and len({keys[1], keys[2], 10}) == 3 and nd._told_apart(signed, None) is signed


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_few_texts_are_compared_in_one_pass_with_the_same_groups(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(150)]
        for _ in range(20):
            text = list(base)
            for _ in range(rng.choice((1, 1, 1, 4))):
                text[rng.randrange(150)] = word()
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows + [(900, rows[3][1]), (901, "alone"), (902, None)], "doc_id bigint, text string")
    made, real, groups = [], nd.durable, []
    monkeypatch.setattr(nd, "durable", lambda d, name: (made.append(name), real(d, name))[1])
    for most in (0, 16 << 20):
        made.clear()
        monkeypatch.setattr(nd, "BROADCAST_BYTES", most, raising=False)
        groups.append(sorted(map(tuple, nd.near_duplicates(df).collect())))
    assert groups[0] == groups[1] and len({c for _, c, n in groups[1] if n > 5}) == 4
    assert made.count("links") > 1 and "close" not in made and made.count("ends") == 1
