import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quernstone.llm import piece_codec, spelling, target_resampling
from quernstone.llm.bytewise import chunks

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list(" \t\n▁abcthe  ing0129.,'éü한日本😀́A\xa0　ﬁ①\x00<s>�ｱﾞ​ǅ")
EXACT = [None, "", " ", "  ", "▁", " ▁ ", "a " * 50, "x" * 3000, " " * 999, "ab" * 40 + "é" * 60, "\U0010ffff", "e" + "́" * 30]


def _texts(seed, n=600):
    rng = random.Random(seed)
    return EXACT + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def _model(rule=None, prefix=True, fold=False, fallback=True):
    proto = sentencepiece_model_pb2.ModelProto.FromString(piece_codec.read_model(MODEL))
    if rule:
        own = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        proto.normalizer_spec.precompiled_charsmap = sentencepiece_model_pb2.ModelProto.FromString(own).normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, fold
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == piece_codec.BYTE:
                p.type, p.score = piece_codec.CONTROL, 0
    return proto.SerializeToString()


@pytest.mark.parametrize("options", [{}, {"fallback": False}, *({"rule": r, "prefix": p, "fold": f} for r in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf") for p in (True, False) for f in (True, False))], ids=str)
def test_ids_spans_and_decoding_equal_the_library(options):
    serialized = _model(**options)
    own, library = piece_codec.Model(serialized), sentencepiece.SentencePieceProcessor(model_proto=serialized)
    decoder, texts = piece_codec.Decoder(own), _texts(len(str(options)))
    for t in chunks(pa.array(texts, pa.string()), 700):
        counts, ids, begin, end = own.encode(t)
        for k in range(len(t)):
            text, part = texts[t.first + k] or "", slice(counts[k], counts[k + 1])
            told = library.encode(text, return_type="proto").pieces
            assert ids[part].tolist() == [p.id for p in told], text
            assert list(zip(begin[part].tolist(), end[part].tolist(), strict=True)) == [(p.begin, p.end) for p in told], text
            assert decoder.decode(ids[part].tolist()) == library.decode(ids[part].tolist()), text


def test_decoding_of_any_ids():
    rng, serialized = random.Random(3), piece_codec.read_model(MODEL)
    decoder, library = piece_codec.Decoder(piece_codec.Model(serialized)), sentencepiece.SentencePieceProcessor(model_proto=serialized)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 258), 28705, 259, 0, 1, 2]) for _ in range(rng.randint(0, 9))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_longest_prefix_by_brute_force():
    """The map's keys, found by walking all of it, and the longest one at each place of a text."""
    m = piece_codec.Model(_model("nfkc")).map
    text = "ﬁａé①가x" * 3
    (t,) = chunks(pa.array([text, "é"]))
    at = [k for k in range(len(t.data)) if (t.data[k] & 0xC0) != 0x80]
    length, _ = m.longest(t.data, t.stop[[0 if k < t.stop[0] else 1 for k in at]], piece_codec.np.array(at))
    raw = bytes(t.data)
    for k, n in zip(at, length.tolist(), strict=True):
        stop = int(t.stop[0] if k < t.stop[0] else t.stop[1])
        alone = [j for j in range(1, stop - k + 1) if m.longest(t.data, piece_codec.np.array([k + j]), piece_codec.np.array([k]))[0][0] == j]
        assert n == max(alone, default=0), raw[k:stop]


def test_models_that_are_no_bpe_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(piece_codec.read_model(MODEL))
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        piece_codec.Model(proto.SerializeToString())


def test_remembered_stretches_are_let_go(monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 5)
    own, library, texts = piece_codec.Model(piece_codec.read_model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL), _texts(8, 60)
    for t in chunks(pa.array(texts, pa.string()), 90):
        counts, ids, *_ = own.encode(t)
        assert [ids[counts[k] : counts[k + 1]].tolist() for k in range(len(t))] == [library.encode(texts[t.first + k] or "") for k in range(len(t))]


def test_digests_of_odd_rows(spark, odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))

    def of(text):
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        return len(ids), *sha, len((text or "").encode())

    got = sorted((tuple(r) for r in piece_codec.digests(docs, MODEL).collect()), key=str)
    assert got == sorted(((r.doc_id, *of(r.text)) for r in odd.collect()), key=str)
    assert piece_codec.digests(nothing, MODEL).count() == 0


def test_texts_come_back_with_their_columns(spark, odd):
    docs = odd.withColumn("ids", F.lit("clash"))
    there = piece_codec.encode(docs, MODEL)
    back = piece_codec.decode(there, MODEL)
    assert set(docs.columns) - {"ids"} | {"begins", "ends"} == set(back.columns)
    assert sorted(str(r.text or "") for r in odd.collect()) == sorted(r.text for r in back.collect())


# Resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _grams(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _resampled(docs, target):
    bucket = lambda gram: zlib.crc32(gram.encode()) % 10000
    s, t = (collections.Counter(bucket(g) for text in texts for g in _grams(text)[1]) for texts in ([d[1] for d in docs], target))
    big_s, big_t, rows = sum(s.values()), sum(t.values()), []
    for doc_id, text in docs:
        words, grams = _grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in map(bucket, grams))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    pool = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    place = {}
    for k, r in enumerate(pool[: 5 * len(pool) // 100]):
        place.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], place[r].pop(0) if place.get(r) else None) for r in rows), key=str)


def _told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resampling_by_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["Ab", "c", "de9", "é", "漢字", "F", "g-h", "i.j", "K", "lm"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 21, 60])))) for k in range(400)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, "no id " * 10), (None, "no id " * 10), (900, None), (901, ""), (902, "z " * 40_000)]
    target = ["Ab c de9", None, "", "漢字 é é é"]
    got = target_resampling.resample(
        spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS gain", "3 AS bucket", "4 AS n", "5 AS row").repartition(7), spark.createDataFrame([(x,) for x in target], "text string").selectExpr("*", "1 AS n")
    )
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _told(got) == _resampled(docs, target)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 1 + 5 * sum(len(_grams(t)[0]) >= 20 for _, t in docs) // 100))


def test_resampling_of_odd_and_empty_tables(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _told(target_resampling.resample(odd, nothing)) == _resampled(rows, [])
    assert target_resampling.resample(nothing, odd).count() == 0


# Spelling


def _worn(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(docs):
    n, out, form = _worn(docs), [], {}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out, key=str)


def _corpus(seed):
    rng, words = random.Random(seed), []
    for _ in range(25):
        word = "".join(rng.choice("abÀéz") for _ in range(rng.randint(6, 9)))
        for times in (200, 30, 5):  # variants of variants: chains
            words += [word.upper() if rng.random() < 0.1 and word.isascii() else word] * times
            k = rng.randrange(len(word) + 1)
            word = rng.choice([word[:k] + rng.choice("abÀéz") + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice("abÀéz") + word[k + 1 :]])
    rng.shuffle(words)
    return [(k, rng.choice([" ", ", ", "1"]).join(words[k::97])) for k in range(97)] + [(None, " ".join(words[:50])), (3, None), (4, "")]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"shard_words": 7, "pack_bytes": 2000})])
def test_variants_by_brute_force(spark, seed, options):
    docs = _corpus(seed)
    got = spelling.variants(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run").repartition(5), **options)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = _variants(docs)
    assert _told(got) == want
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] > 1 for r in want)


def test_trie_finds_each_neighbour_once():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(90)})
    trie = spelling.Trie.load(spelling.Trie.build(words, list(range(1, len(words) + 1))).dump())
    for w in [*words, "", "aaaaaaaa", "zz"]:
        assert sorted(trie.near(w)) == [(x, words.index(x) + 1) for x in words if _one_edit(w, x)]
    assert spelling.Trie.build([], []).near("abc") == []


def test_variants_of_odd_and_empty_tables(spark, odd, nothing):
    assert _told(spelling.variants(odd)) == _variants([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(nothing).count() == 0
