"""The pipeline on the smallest tables, each stage against brute force on its own input."""

import base64
import collections
import importlib
import math
import os
import random
import re

import duckdb

import corpus_pipeline
from quernstone.llm.store import durable, scratch
from tests.llm.test_decontaminate import _brute as leaks
from tests.llm.test_near_dedup import _brute as groups
from tests.llm.test_other_operators import WORD, _targets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    rng = random.Random(3)
    junk = ["".join(rng.choice("0123456789abcdef") for _ in range(3000)), base64.b64encode(rng.randbytes(2000)).decode(), "".join(rng.choice("asdfghjkl; qwertyuiop") for _ in range(1500))]
    rows = [(-1, None, "en", "a", 0), (-2, "12 !!", "en", "a", 5), (-3, "", None, None, 0)] + [(-10 - k, x, None, "a", 0) for k, x in enumerate(junk)]
    odd = spark.createDataFrame([*rows, (-20, "asdf jkl", None, "a", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id): r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert set(before) - {r.doc_id for r in after} == {-1, -2, -3, -10, -11, -12}
    before, after = seen["near_dedup"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [(i, " ".join(word.findall(r.text.lower()))) for i, r in sorted(before.items())]
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in groups(texts).items() if i == c)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {i for i, r in before.items() if not leaks(items, r.text)[4]}
    before, after = seen["source_mix"]
    size = {i: len(WORD.findall(r.text)) for i, r in before.items()}
    sizes = collections.Counter()
    for i, r in before.items():
        sizes[r.source] += size[i]
    want, times = _targets(sizes), collections.Counter(r.doc_id for r in after)
    for s in want:
        own = [i for i, r in before.items() if r.source == s]
        taken = sum(size[i] * times[i] for i in own)
        assert abs(taken - want[s]) <= max(size[i] for i in own) / 2 + 1
        assert all(math.floor(want[s] / sizes[s]) <= times[i] <= 2 for i in own)
    before, after = seen["sharding"]
    total = [0] * 8
    for r in after:
        total[r.shard] += len(r.text.encode()) + 1
    most = max(len(r.text.encode()) + 1 for r in after)
    assert max(total) - min(total) <= 4 * most and sum(times.values()) == len(after)
    ordered = sorted(after, key=lambda r: r.doc_id)
    assert [r.shard for r in ordered] == sorted(r.shard for r in after)


def test_repeated_ids(spark):
    """Ids that stand for several texts: each stage judges rows, so that clean ones stay."""
    a, b = (" ".join(f"{x}{i % 7}{i}" for i in range(80)) for x in ("the ring", "and other"))
    rows = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (6, a, "en", "t", 0), (6, None, "en", None, 0), (None, b, "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, a), (5, b), (6, ""), (0, b)])
    assert corpus_pipeline.drop_benchmark_text(spark, kept, SF).count() == 4 and corpus_pipeline.cut_shards(spark, kept, SF).count() == 4
    mixed = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, kept, SF).collect())
    assert set(mixed) <= {(r.doc_id, r.text) for r in kept.collect()} and max(mixed.values()) <= 2


def test_scratch_goes(spark):
    with scratch(spark):
        table = durable(spark.range(3).toDF("x"), "here")
        path = table.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_queries_and_sql_agree(spark):
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.oracle_sql() if n.startswith("op")]
    assert sum(n.startswith("op") for n in entry.queries()) == 10 and "pipeline" in entry.queries()
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: "NULL" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in names:
        df = entry.queries()[name](spark, SF)
        found = c.execute(entry.oracle_sql()[name])
        at = [d[0] for d in found.description]
        assert sorted(at) == sorted(df.columns)
        assert sorted(tuple(plain(r[at.index(k)]) for k in sorted(at)) for r in found.fetchall()) == sorted(tuple(plain(r[k]) for k in sorted(at)) for r in df.collect())
