import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat_format, doc_stats, html_text, language_id, license_scan, mixing, quality_model, robust_rules, sharding
from quernstone.llm.bytewise import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Statistics and rules


def _base(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)]


def test_base_counts_match_brute_force():
    rng = random.Random(5)
    texts = ["", None, "\n\n", "a a a a", "é é é é", "a\n\n a\na\na\r\n a", "|||"] + ["".join(rng.choice("ab \n\té#\x0b漢") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = np.concatenate([doc_stats.counts(t) for t in chunks(pa.array(texts), 300)])
    assert got[:, :5].tolist() == [_base(t) for t in texts]


def test_all_counts_match_brute_force():
    rng = random.Random(6)
    texts = ["", "a a a", "A! b? é\n\nb b", "x,y;z.: !!"] + ["".join(rng.choice("abAB \n\té!?.,9漢") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    got = np.concatenate([doc_stats.counts(t) for t in chunks(pa.array(texts), 400)])
    for row, text in zip(got.tolist(), texts, strict=True):
        words = WORD.findall(text)
        c = collections.Counter(words)
        want = {
            "n_chars": len(text), "n_lines": sum(bool(WORD.search(x)) for x in text.split("\n")), "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_marks": text.count("!"),
            "n_stops": len(re.findall("[.,;:?]", text)), "n_wide": sum(ord(x) > 127 for x in text), "n_distinct": len(c), "n_top": max(c.values(), default=0), "n_twice": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        }
        assert {k: row[doc_stats.COUNTS.index(k)] for k in want} == want


def _rule_rows():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        if i % 30 == 1:
            words = [w + "***" for w in words]
        if i % 30 == 2:
            words = [w.upper() for w in words]
        if i % 30 == 3:
            words = words[:20]
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "s"))
    return rows


def test_rules_reject_outliers_only(spark):
    found = {r.doc_id: r for r in robust_rules.quality_rules(spark.createDataFrame(_rule_rows(), "doc_id bigint, text string, lang string, source string")).collect()}
    assert len(found) == 300
    assert {i for i, r in found.items() if not r.kept} == {i for i in range(300) if i % 30 in (1, 2, 3)}
    assert {i for i, r in found.items() if r.base_failed} == {i for i in range(300) if i % 30 == 3}


def _vectors(spark, groups):
    rows = [(key, *map(int, r)) for key, x in groups.items() for r in x]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{v} bigint" for v in robust_rules.VECTOR)).repartition(3)


def _logdet(x):
    return np.linalg.slogdet(np.cov(x.T / 1000, bias=True) + np.diag(np.square(robust_rules.FLOOR)))[1]


def test_mcd_against_all_subsets(spark):
    """Small groups: the determinant found is the least of all subsets with the share of the rows."""
    groups = {}
    for seed in range(8):
        rng = np.random.default_rng(seed)
        x = np.abs(rng.normal([5, 0.2, 0.2, 0.2, 0.3], [1.5, 0.3, 0.3, 0.3, 0.3], (14, 5)))
        x[: seed % 4] += [4, 2, 0, 2, 1]
        groups[f"g{seed}"] = np.round(1000 * x)
    found = {r.key: r for r in robust_rules.estimate(_vectors(spark, groups)).collect()}
    size = math.ceil(robust_rules.SHARE * 14)
    for key, x in groups.items():
        least = min(_logdet(x[list(c)]) for c in itertools.combinations(range(14), size))
        assert found[key].settled and found[key].n == 14 and abs(found[key].logdet - least) < 1e-9


def test_mcd_of_a_large_group(spark):
    """Planted outliers neither move the mean nor blow up the covariance; the estimate is a fixed point, and reruns agree."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal([5, 0.1, 0.1, 0.1, 0.2], [0.5, 0.05, 0.05, 0.05, 0.05], (3000, 5)))
    x[:600] += [0, 1, 0, 1, 1]
    x = np.round(1000 * x)
    vectors = _vectors(spark, {"g": x, "same": np.tile(x[-1], (400, 1)), "one": x[:1]})
    found = {r.key: r for r in robust_rules.estimate(vectors).collect()}
    got = found["g"]
    assert got.settled and np.allclose(got.form[:5], x[600:].mean(0) / 1000, atol=0.02)
    full = np.zeros((5, 5))
    for k, (i, j) in enumerate(robust_rules.PAIRS):
        full[i, j] = full[j, i] = got.form[5 + k] * (1 if i == j else 0.5)
    d = np.einsum("ni,ij,nj->n", x / 1000 - got.form[:5], full, x / 1000 - got.form[:5])
    core = x[np.argsort(d)[: math.ceil(robust_rules.SHARE * len(x))]]
    assert not set(np.argsort(d)[: len(core)]) & set(range(600)) and abs(_logdet(core) - got.logdet) < 1e-3
    assert np.allclose(found["same"].form[:5], x[-1] / 1000) and found["one"].settled
    again = {r.key: r for r in robust_rules.estimate(vectors.repartition(5)).collect()}
    assert again == found


def test_small_groups_are_judged_by_their_language(spark):
    """Ten texts in capitals make up a source: too few to set their own standard, they are outliers of their language."""
    rows = _rule_rows() + [(1000 + k, " ".join(["WORD", "OTHER", "LETTERS"][(k + i) % 3] + "ABC"[i % 2] * (i % 4) for i in range(80)), "en", "loud") for k in range(10)]
    found = {r.doc_id: r.kept for r in robust_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(found[1000 + k] for k in range(10)) and sum(found.values()) == 270


def test_rules_on_odd_rows(spark, odd, nothing):
    rows = robust_rules.quality_rules(odd).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    assert robust_rules.quality_rules(nothing).count() == 0


# Quality model


def test_quality_on_held_out_rows(spark):
    rows = _rule_rows()
    labels = spark.createDataFrame([(i, int(i % 30 not in (1, 2)), 0) for i in range(300)] + [(7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = quality_model.quality(docs, labels, held_out="crc32(cast(doc_id AS string)) % 5 = 0").collect()
    out = [r for r in found if r.held_out]
    assert len(found) == 300 and {r.doc_id for r in out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 30 not in (1, 2)) for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_forest_walk_matches_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality_model.train(x, y)
    plain = []
    for row in x:
        total = forest.base
        for f, th, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > th[at] else 1)
            total += leaf[at - len(f)]
        plain.append(total)
    assert np.allclose(plain, forest.margin(x)) and ((forest.probability(x) > 0.5) == y).mean() > 0.97


def test_quality_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1)], "doc_id bigint, quality int")
    for lab in (labels, labels.limit(0)):
        rows = quality_model.quality(odd, lab, held_out="doc_id = 1").collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.quality(nothing, labels, held_out="doc_id = 1").count() == 0


# Language


def _language_rows():
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "er", "and", "th", "ou"], "fr": ["eau", "é", "que", "ou", "le", "ch"], "de": ["sch", "ung", "ein", "ü", "pf", "und"]}
    text = lambda p: " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80)))
    return [(i, text(parts[lang]), lang if i % 11 else None, "s") for i, lang in enumerate(sorted(parts) * 120)]


def test_language_on_held_out_rows(spark):
    rows = _language_rows()
    truth = dict(zip((r[0] for r in rows), sorted(("en", "fr", "de")) * 120, strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = language_id.identify(docs, held_out=F.crc32(docs["doc_id"].cast("string")) % 3 == 1).collect()
    out = [r for r in found if r.held_out]
    assert len(found) == len(rows) and {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 255, 256, 257, 508, 509, 5000])
def test_windows_hold_every_run_of_bytes(n):
    data = np.random.default_rng(n).integers(1, 255, n).astype(np.uint8)
    w = language_id.windows_of(data)
    runs = {tuple(data[i : i + language_id.WIDTH]) for i in range(n - language_id.WIDTH + 1)}
    assert runs <= {tuple(r[i : i + language_id.WIDTH]) for r in w for i in range(len(r) - language_id.WIDTH + 1)}
    assert (len(w) > 0) == (n > 0)


def test_two_forms_of_the_network_agree():
    net = language_id.train(["the cat and the dog " * 5, "le chat et le chien " * 5] * 10, ["en", "fr"] * 10)
    x = np.random.default_rng(0).integers(0, 255, (40, 64)).astype(np.uint8)
    z = np.maximum(net.pooled(x)[1], 0) @ net.out + net.bias
    assert np.allclose(net.log_probabilities(x), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)


def test_network_matches_plain_convolution():
    net = language_id.train(["the cat and the dog " * 5, "le chat et le chien " * 5] * 10, ["en", "fr"] * 10)
    x = np.random.default_rng(1).integers(0, 255, (3, 40)).astype(np.uint8)
    want = []
    for row in x:
        hidden = []
        for f in range(net.filters.shape[1]):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            taps = net.filters[:, f].reshape(language_id.WIDTH, language_id.DIM)
            assert not taps[width:].any()
            at = [sum(float(net.vectors[row[i + k]] @ taps[k]) for k in range(width)) for i in range(len(row) - language_id.WIDTH + 1)]
            hidden.append(max(0.0, max(at) + net.shift[f]))
        z = np.array(hidden) @ net.out + net.bias
        want.append(z - np.log(np.exp(z).sum()))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-3)


def test_least_by_hash(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), (F.col("id") % 5000).alias("id"), F.xxhash64(F.col("id") % 5000).alias("h"))
    got = language_id.least_by_hash(rows, "k", "h", 300).collect()
    for key in ("hot", "cold"):
        own = [r for r in got if r.k == key]
        every = sorted(rows.filter(F.col("k") == key).distinct().collect(), key=lambda r: (r.h % (1 << 30), r.h))
        assert len({r.id for r in own}) == len(own) == 300 and {r.id for r in own} == {r.id for r in every[:300]}


def test_noise_is_told_from_language():
    rows = _language_rows()
    net = language_id.train([t for _, t, _, _ in rows] * 4, [r[2] or "en" for r in rows] * 4)
    rng = random.Random(77)
    junk = ["".join(rng.choice("0123456789abcdef") for _ in range(3000)), "".join(rng.choice("asdfghjkl;") for _ in range(2000)), " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(300)),
            base64.b64encode(rng.randbytes(2000)).decode()]
    t = next(chunks(pa.array([x.lower() for x in junk] + [r[1] for r in rows]), 1 << 30))
    _, _, noise, letters = language_id.classify(net, t, np.ones(len(t), bool))
    assert (noise[:4] > 0.5).all() and letters[1] > 1500
    assert (noise[4:][letters[4:] >= 200] < 0.5).all()


def test_language_on_odd_rows(spark, odd, nothing):
    rows = language_id.identify(odd, held_out=F.col("doc_id") == 1).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 4)} == {i: ("und", 0.0) for i in (1, 2, 3, 4)}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled, held_out=F.col("doc_id") == 1).collect()} == {"und"}
    assert language_id.identify(nothing, held_out=F.col("doc_id") == 1).count() == 0


# Mixing


def _targets(sizes):
    """Water-filling step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not above:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in above:
            out[s] = 2 * sizes[s]
        rest -= sum(out[s] for s in above)
        open_ -= above


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 50 else None, "en", rng.choice(["b", "a", "é", "Z", None, "big", "big", "big"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = _targets(sizes), collections.Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.size * math.floor(r.target / r.source_size) <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)
    assert sorted(found) == sorted(mixing.mix(docs.repartition(7)).collect())
    whole = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(whole[r.doc_id] * r.size == r.taken for r in found)
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_cuts_large_bins_again(spark, monkeypatch):
    """Few bins and a low limit make the cut fall into bins of bins; what is taken stays the same."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)) + " 12" * rng.randint(0, 30), "en", rng.choice(["a", "b", None])) for i in range(1500)] + [(7, "one two", "en", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BINS", 4)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 20)
    assert sorted(mixing.mix(docs).collect()) == want
    equal = mixing.mix(docs, quality=F.lit(1.0)).collect()
    assert len(equal) == len(rows) and sum(r.taken for r in equal if r.source == "b") > 0


def test_mix_on_odd_rows(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0


# Sharding


def test_shards_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "x" * rng.randint(1, 300), "é" * rng.randint(1, 90)])) for i in rng.sample(range(10_000), 700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assignments(docs).collect()}
    sized = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, slots, want = sum(s for _, s, _ in sized), 0, collections.Counter(), {}
    for i, s, crc in sized:
        k = min(7, (2 * at + s) * 8 // (2 * total))
        want[i] = (s, crc, k, slots[k])
        slots[k] += 1
        at += s
    assert got == want
    assert {r.doc_id: r.shard for r in sharding.with_shard(docs).collect()} == {i: v[2] for i, v in want.items()}


def test_shards_of_odd_rows_and_files(spark, odd, nothing, tmp_path):
    rows = sharding.assignments(odd).collect()
    assert len(rows) == odd.count() and {r.law for r in rows} == {"bytes"}
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.assignments(nothing).count() == 0 and sharding.with_shard(nothing).count() == 0
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


# Licences


def test_licenses(spark, odd, nothing):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 500)
    docs = [(1, "prose\nLicensed under the Apache License, Version 2.0.\nmore"), (2, mit), (3, mit.upper().replace(",", " ;")), (4, "prose about a license of some kind"), (5, "x\n\n" + mit + "\n\ny"), (6, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.licenses, r.best_license, r.best_dice) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0", 1.0), 2: ("MIT", "MIT", 1.0), 3: ("MIT", "MIT", 1.0), 4: ("", None, 0.0), 5: ("MIT", "MIT", 1.0), 6: ("CC-BY-NC-4.0,MIT", "CC-BY-NC-4.0", 1.0)}
    assert license_scan.scan(odd).filter("n_licenses > 0").count() == 0 and license_scan.scan(odd).count() == odd.count() and license_scan.scan(nothing).count() == 0


def test_planted_notices_are_found(spark):
    """Every template within prose: wrapped and marked as a comment above code, inside a paragraph, in paragraphs of its own, slightly changed."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice("alder birch cedar maple oak pine rowan willow yew of the and".split()) for _ in range(n))
    rows = []
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        width = rng.randint(5, 14)
        wrapped = "\n".join("// " + " ".join(words[i : i + width]) for i in range(0, len(words), width))
        rows.append((name, f"// Copyright 2020 {prose(9)}\n{wrapped}\nint main(void) {{ return {prose(30)}; }}"))
        rows.append((name, f"{prose(57)} {text} {prose(41)}"))
        if len(words) > 60:
            third = len(words) // 3
            rows.append((name, f"{prose(80)}\n\n" + "\n\n".join(" ".join(words[i : i + third + 1]) for i in range(0, len(words), third + 1)) + f"\n\n{prose(90)}"))
            changed = [prose(1) if k % 31 == 17 else w for k, w in enumerate(words)]
            rows.append((name, f"{prose(33)} {' '.join(changed)} {prose(21)}"))
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)] + [(-1, prose(400))], "doc_id bigint, text string")
    found = {r.doc_id: r.licenses.split(",") for r in license_scan.scan(docs).collect()}
    assert [i for i, (name, _) in enumerate(rows) if name not in found[i]] == [] and found[-1] == [""]
    probe = spark.createDataFrame([(1, "In short, this project is licensed under the MIT License. See elsewhere for more.")], "doc_id bigint, text string")
    assert license_scan.scan(probe).first().licenses == "MIT"


def test_every_stretch_is_judged(spark):
    """The best stretch of each template by brute force, on texts with notices near the threshold, doubled, cut off and at both ends."""
    rng = random.Random(21)
    prose = lambda n: [rng.choice("alder birch cedar maple oak pine rowan willow yew of the and software to".split()) for _ in range(n)]
    some = [(n, t) for n, t in license_scan.TEMPLATES if n in ("MIT", "ISC", "0BSD", "Zlib", "WTFPL", "Artistic-2.0")]
    texts = ["to", "software of", "The MIT License"]
    for k in range(60):
        name, text = some[k % len(some)]
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        for i in rng.sample(range(len(words)), rng.randint(0, len(words) // 9)):
            words[i] = prose(1)[0]
        cut = rng.randint(0, len(words) // 5)
        texts.append(" ".join(prose(rng.choice((0, 1, 37))) + words[cut:] + prose(rng.choice((0, 3, 50))) + words[: rng.choice((0, len(words)))] + prose(rng.choice((0, 2)))))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), templates=tuple(some)).collect()}
    near = 0
    for k, text in enumerate(texts):
        w, best = text.lower().split(), {}
        for name, template in some:
            b, m = set(license_scan.template_bigrams(template)), license_scan.n_words(template)
            for i, n in [(i, m) for i in range(max(1, len(w) - m + 1))] + [(0, len(w))]:
                part = w[i : i + n]
                a = {f"{x} {y}" for x, y in zip(part, part[1:], strict=False)}
                best[name] = max(best.get(name, 0), 2 * len(a & b) / (len(a) + len(b)))
        want = {n: d for n, d in best.items() if d >= license_scan.DICE}
        near += any(d < 0.85 for d in want.values())
        assert (got[k].licenses, got[k].best_dice) == (",".join(sorted(want)), round(max(want.values(), default=0.0), 6))
    assert near > 5


def test_triggers_lose_no_match():
    """Any set of bigrams without a trigger stays below the threshold with every template."""
    templates = [license_scan.template_bigrams(t) for _, t in license_scan.TEMPLATES]
    words = set(license_scan.triggers(templates, license_scan.DICE))
    for t in templates:
        rest = [b for b in t if not words & set(b.split())]
        assert 2 * len(rest) / (len(rest) + len(t)) < license_scan.DICE


# Pages


def test_main_text():
    page = """<html><head><title>x</title></head><body><header class="site"><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies.</div>
<div class="content"><h1>Head &amp; line</h1><p>First para with some words in it, enough to matter.</p><aside>Related stuff</aside><p>Second <i>para</i>graph   with
 newline and&nbsp;more.</p><ul><li>one point here<li>two point there</ul><div class="ad-slot">Buy now!</div><blockquote>Quoted words go here.</blockquote></div>
<section id="comments"><p>Great article, thanks for it all my friend</p></section><form><label>Mail</label></form><footer>c 2020</footer><script>if (a<b) x("<p>no</p>")</script></body></html>"""
    want = "Head & line\nFirst para with some words in it, enough to matter.\nSecond paragraph with newline and more.\none point here\ntwo point there\nQuoted words go here."
    weights = html_text.learn([])
    assert html_text.extract(page, weights) == want
    assert html_text.extract(page.replace('<div class="content">', "<article>").replace("</blockquote></div>", "</blockquote></article>"), html_text.learn([page])) == want


def test_names_weigh_but_do_not_decide():
    """What is alone on its page stays whatever its name; beside an article the same name goes. Compounds lean by all their parts."""
    words = "many words of the article itself, " * 12
    weights = html_text.learn([])
    said = html_text._SPACE.sub(" ", words).strip()
    assert html_text.extract(f'<html><body><h1>Head</h1><div class="message"><p>{words}</p></div></body></html>', weights) == f"Head\n{said}"
    assert html_text.extract(f'<div class="post"><p>{words}</p></div><div class="message"><p>You have mail</p></div>', weights) == said
    assert html_text.extract(f'<div><p>{words}</p><p class="meta-analysis">A meta analysis says so.</p><ul class="tags-explained"><li>tags are labels</li></ul><p>More of {words}</p></div>', weights) == f"{said}\nA meta analysis says so.\ntags are labels\nMore of {said}"
    many = "<article class='comment'><p>Nice one indeed, thank you so much</p></article>" * 60
    assert html_text.extract(f'<div class="entry has-sidebar"><p>{words}</p></div><div id="comments">{many}</div>', weights) == said
    assert html_text.extract(f'<div class="single no-comments"><p>{words}</p><div class="ad-slot">Buy now</div></div>', weights) == said
    # Names of attributes with digits, hidden as a part of a layout name, pages that are one form, bodies hidden until a script runs.
    assert html_text.extract(f"<p data-h1='the hidden cost'>{words}</p>", weights) == said
    assert html_text.extract(f'<div class="overflow-hidden md:hidden"><p>{words}</p></div><div class="box"><p>Some other words.</p></div>', weights) == f"{said}\nSome other words."
    assert html_text.extract(f'<div class="entry"><p>{words}</p></div><div class="hidden">away</div><div hidden="">away</div><p hidden>away</p>', weights) == said
    site = f'<form id="aspnetForm"><nav>Home</nav><div id="content"><h1>Head</h1><p>{words}</p></div><fieldset>Mail to us</fieldset><div class="sidebar">See also</div><footer>c</footer></form>'
    assert html_text.extract(f"<html><body>{site}<script>x()</script></body></html>", weights) == f"Head\n{said}"
    assert html_text.extract(f'<body style="visibility: hidden"><p>{words}</p><form class="post">Your mail <p>Send it to us</p></form></body>', weights) == said


def test_names_are_learned_from_labelled_pages():
    page = lambda k: f'<div class="zork"><p>Elsewhere {k}</p></div><article><div class="promo">{"real words here " * 30}</div></article>'
    odds = html_text.learn([page(k) for k in range(40)])[2]
    assert odds["zork"] < 0.2 and odds["promo"] > 0.8 and html_text.learn([])[2] == {}


def test_article_bounds():
    weights = html_text.learn([f"<p>before {k}</p><article><p>{'inside ' * 20}</p></article><p>after</p>" for k in range(30)])
    assert html_text.extract("Skip this<article><p>The text.</p></article> trailing words", weights) == "The text."


def test_pages_are_read_in_linear_time():
    def took(page):
        began = time.perf_counter()
        html_text.extract(page, html_text.learn([]))
        return time.perf_counter() - began

    for unit in ("<article><p>a b</p></article>", "</i></u>", "<b>", "<div class=ad>", "<a ", "<p>x"):
        assert took(unit * 20_000) < 20 * took(unit * 2_000) + 0.5


def test_best_stretch_matches_brute_force():
    rng = random.Random(3)
    weights = html_text.learn([])
    for _ in range(100):
        page = "".join(rng.choice(["<p>", "</p>", "<i>", "<li>", " word", " two words", "<td>"]) for _ in range(25))
        tokens, _ = html_text.read(page)
        score = html_text.scores(tokens, weights)
        assert all((s > 0) == (x[0] == "t" and bool(x[1].split())) for s, x in zip(score, tokens, strict=True) if x[0] == "/" or x[1].split())
        best = max((sum(score[i:j]) for i in range(len(score)) for j in range(i, len(score) + 1)), default=0)
        got = html_text.extract(page, weights).split()
        ways = [(sum(score[i:j]), "".join(x[1] if x[0] == "t" else "\n" if x[1] in html_text.BLOCKS else "" for x in tokens[i:j]).split()) for i in range(len(score)) for j in range(i, len(score) + 1)]
        assert best <= 0 and not got or any(abs(s - best) < 1e-9 and w == got for s, w in ways)


def test_odd_pages(spark):
    rows = [
        (1, "u", None, ""), (2, None, "", ""), (None, "u", "<", "<"), (3, "u", "plain", "plain"), (3, "u", "plain", "plain"), (4, "u", "<div class='ad'>x", "x"), (5, "u", "<p>a<p>b", "a\nb"), (6, "u", "<!-- <p>x</p>", ""),
        (7, "u", '<a href="x>y</a> <p>z</p>', "z"), (8, "u", "<b>" * 20_000 + "deep", "deep"), (9, "u", "</div></p>a &amp; b&nbsp;c</b>", "a & b c"), (10, "u", "<script>x</script>", ""), (11, "u", "<p>a\x00b</p>", "a\x00b"), (12, "u", "\n \n", ""),
        (13, "u", "<p>" + "long text " * 100_000 + "</p>", ("long text " * 100_000).strip()),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).coalesce(1)
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()]
    assert got == [(i, u, text, len(text)) for i, u, _, text in rows]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# Chats


def test_chats_read_back(spark):
    rng = random.Random(6)
    bits = ["\\", "#", "### Assistant: ", "</turn>\n", "<", "\\h", "\\l", "\\c", ":", "é", "\n", "漢", "<image 1>", "\\\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "Assistant", "a:b\\c", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) if rng.random() < 0.9 else None) for c in range(40) for t in range(rng.randint(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    made = chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: r[:2]):
        want[c].append((role or "", text or ""))
    for r in chat_format.read_back(made).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(role.lower() == "assistant" for role, _ in want[r.conv_id])
        assert r.formatted.count("</turn>") == len(want[r.conv_id])


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <image 1> "), part("image", uri="a.png", w=28, h=15), part("audio", uri="b.wav", s=1.5)]), (1, 1, "assistant", [part("document", uri="c.pdf", p=2), part("text", " ok then")]), (2, 0, "user", None)]
    made = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS}")).collect()}
    assert made[1].formatted == "### user: see \\limage 1> <image 1><audio 2></turn>\n### assistant: <document 3> ok then</turn>\n"
    assert [(a.placeholder, a.type, a.uri, a.tokens) for a in made[1].attachments] == [("<image 1>", "image", "a.png", 4), ("<audio 2>", "audio", "b.wav", 50), ("<document 3>", "document", "c.pdf", 1200)]
    assert made[1].tokens == 3 + 4 + 50 + 1200 + 2
    s = made[1].loss_spans[0]
    assert made[1].formatted[s.start : s.start + s.length] == "<document 3> ok then"
    assert made[2].formatted == "### user: </turn>\n" and made[2].tokens == 0


def test_a_long_conversation_is_read_back_from_blocks(spark):
    said = "wörd #<\\ \U0001f642 " * 40  # three blocks' worth in eight turns, with characters beyond the basic plane
    n = 600
    turns = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    got = chat_format.digests(chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(F.col("text"))))).collect()
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(n, len(said) * n // 2, hashlib.sha256((said * (n // 2)).encode()).hexdigest())]


def test_odd_chats(spark):
    """Null ids make one conversation, equal numbers go by role and text, repeated turns stay, other columns don't matter."""
    rows = [(None, 1, "user", "a"), (None, None, "assistant", None), (1, 2, "user", "b"), (1, 2, "assistant", "z"), (1, 2, "assistant", "c"), (1, 2, "user", "b"), (2, 1, None, "x"), (3, 1, "Assistant", "é</turn>\n\U0001f642" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    for name in ("number", "before", "formatted", "head", "body", "piece", "tokens", "n_turns"):
        turns = turns.withColumn(name, F.lit("clash"))
    made = chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_back(made).collect()}
    assert got == {None: [("assistant", ""), ("user", "a")], 1: [("assistant", "c"), ("assistant", "z"), ("user", "b"), ("user", "b")], 2: [("", "x")], 3: [("Assistant", "é</turn>\n\U0001f642" * 5000)]}
    by = {r.conv_id: r for r in chat_format.digests(made).collect()}
    assert by[1].loss_chars == 2 and by[3].loss_sha256 == hashlib.sha256(("é</turn>\n\U0001f642" * 5000).encode()).hexdigest() and by[2].loss_chars == 0


def test_no_chats(spark):
    none = spark.createDataFrame([], f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS}")
    assert chat_format.digests(chat_format.format_chats(none)).count() == 0
