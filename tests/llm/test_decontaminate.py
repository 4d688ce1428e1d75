import hashlib
import random
import re

import pytest

from quernstone.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(items, text, k=10):
    w, hit, found = _words(text), set(), set()
    for item, body in items:
        x = _words(body)
        n = min(k, len(x))
        windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if n and tuple(w[j : j + n]) in windows:
                hit |= set(range(j, j + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_words", [200_000, 12])
def test_matches_brute_force(spark, max_words):
    rng = random.Random(max_words)
    words = ["alpha", "Beta", "gamma", "été", "9"]
    text = lambda a, b: rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randint(a, b)))
    items = [(i, text(0, 16)) for i in range(12)] + [(12, None), (13, "one two three"), (14, "single")]
    docs = [(i, text(0, 80) + rng.choice(["", " one two three", " single"])) for i in range(40)] + [(40, None), (41, "")]
    docs += [(42, "x " + items[2][1] + " y " + items[5][1])]
    got = dc.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_words=max_words, window=4).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: _brute(items, t, 4) for i, t in docs}


def test_cutting_and_dropping(spark):
    item = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"start of it, {item}; the end and much more of it to keep the share low", 5), (2, item, 6), (3, "clean", 7)], "doc_id bigint, text string, extra int")
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    cut = {r.doc_id: (r.text, r.extra) for r in dc.decontaminate(docs, bench, max_coverage=0.6).collect()}
    assert cut == {1: ("start of it, ; the end and much more of it to keep the share low", 5), 3: ("clean", 7)}
    assert [r.doc_id for r in dc.decontaminate(docs, bench).collect()] == [3]
    assert {r.doc_id for r in dc.decontaminate(docs, bench, max_coverage=0.6, max_span=12).collect() if "t5" in r.text} == {1}


def test_limits_hold_for_all_pieces_together(spark):
    """Two items in pieces of their own: their spans count together, and the text is cut once."""
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    docs = spark.createDataFrame([("x", f"{a} {' '.join(['w'] * 40)} {b}", 1), ("y", f"{a} {' '.join(['w'] * 40)}", 2), ("x", "clean", 3), (None, None, 4)], "doc_id string, text string, spans int")
    bench = spark.createDataFrame([("i", a), ("j", b)], "item_id string, text string")
    for words in (200_000, 5):
        left = sorted((r.spans, r.text) for r in dc.decontaminate(docs, bench, max_coverage=0.3, max_words=words).collect())
        assert left == [(2, " " + " ".join(["w"] * 40)), (3, "clean"), (4, None)]
        rows = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in dc.contamination(docs, bench, max_words=words).collect()}
        assert rows == {("x", 64, 24, 2), ("y", 52, 12, 1), ("x", 1, 0, 0), (None, 0, 0, 0)}


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(0, "same text here"), (1, None), (2, "")], "item_id bigint, text string")
    rows = dc.contamination(odd, bench).collect()
    assert len(rows) == odd.count() and sorted(r.doc_id for r in rows if r.contaminated) == [5, 5, 6]
    assert dc.decontaminate(odd, bench).columns == odd.columns and dc.decontaminate(odd, bench).count() == odd.count() - 3
    empty = bench.limit(0)
    assert dc.contamination(odd, empty).filter("contaminated").count() == 0
    assert dc.contamination(nothing, bench).count() == 0
