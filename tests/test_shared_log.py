import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from quernstone.operators import hot
from quernstone.sources.catalog import create_once, numbered
from quernstone.streaming import log as sl
from quernstone.streaming import shared_log as sh

DDL = "arrival bigint, dedup_key string, raw string, source string, event_type string"


def _rows(keys, start=0, source="live"):
    return [(start + i, f"d{k}", f"raw{k}", source, "message") for i, k in enumerate(keys)]


def test_two_streams_share_one_log_without_gap_or_repeat(spark, tmp_path):
    path = str(tmp_path / "log")
    df = lambda rows: spark.createDataFrame(rows, DDL).repartition(3)
    assert sh.read(spark, path) is None and sh.commits(spark, path).count() == 0
    assert sh.append_batch(df(_rows([3, 1, 2, 1])), path, "a", 0) == 3
    assert sh.append_batch(df(_rows([2, 7, 8])), path, "b", 0) == 2  # d2 is known from the other stream
    assert sh.append_batch(df(_rows([99])), path, "a", 0) == 0  # sent again, whatever it holds
    assert sh.append_batch(df(_rows([1, 2])), path, "a", 1) == 0  # nothing new, committed all the same
    assert sh.append_batch(df([]), path, "a", 2) == 0
    assert sh.append_batch(df([*_rows([5]), (9, "d6", "x", "nowhere", "message"), (10, None, "x", "live", "message")]).withColumn("extra", F.lit(1)).withColumn("seq", F.lit(77)), path, "a", 3) == 1
    got = sh.read(spark, path)
    assert [(r.seq, r.dedup_key, r.extra) for r in got.orderBy("seq").collect()] == [(1, "d3", None), (2, "d1", None), (3, "d2", None), (4, "d7", None), (5, "d8", None), (6, "d5", 1)]
    assert sh.read(spark, path, 1).count() == 3
    now = sh.head(spark, path)
    assert (now["number"], now["head"], now["streams"]) == (5, 6, {"a": 3, "b": 0})
    assert sorted(r.fault for r in spark.read.parquet(f"{path}/rejected").collect()) == ["event_id", "source"]  # without a key there is no id


def test_a_batch_that_comes_second_is_numbered_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    real, other = sh.create_once, []

    def late(session, name, text):
        if not other:  # another stream commits first, with one of the same events
            other.append(1)
            sh.append_batch(spark.createDataFrame(_rows([1, 50]), DDL), path, "b", 0)
        return real(session, name, text)

    monkeypatch.setattr(sh, "create_once", late)
    assert sh.append_batch(spark.createDataFrame(_rows([1, 2, 3]), DDL), path, "a", 0) == 2
    assert [(r.seq, r.dedup_key) for r in sh.read(spark, path).orderBy("seq").collect()] == [(1, "d1"), (2, "d50"), (3, "d2"), (4, "d3")]


def test_streams_at_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for s in range(3):
        spark.createDataFrame(_rows(range(s * 20, s * 20 + 40)), DDL).repartition(2).write.parquet(f"{tmp_path}/in{s}")
    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(lambda s=s: sh.append(sl.source(spark, f"{tmp_path}/in{s}", DDL, files_per_batch=1), path, f"s{s}", f"{tmp_path}/c{s}").awaitTermination()) for s in range(3)]
        [r.result() for r in runs]
    got = sh.read(spark, path).collect()
    assert sorted(r.seq for r in got) == list(range(1, 81)) and len({r.dedup_key for r in got}) == 80
    # The rows of a commit are those it says, and commits follow each other.
    ends = [(r.first, r.rows, r.head) for r in sh.commits(spark, path).orderBy("number").collect() if r.rows]
    assert all(f + n - 1 == h for f, n, h in ends) and [f for f, _, _ in ends][1:] == [h + 1 for _, _, h in ends][:-1]


def test_create_once(spark, tmp_path):
    name = numbered(f"file://{tmp_path}/x", 3)
    assert create_once(spark, name, json.dumps({"a": 1})) and not create_once(spark, name, "{}")
    assert json.loads((tmp_path / "x" / "000000000003.json").read_text()) == {"a": 1}


def test_numbers_over_many_rows(spark):
    n = 200_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 20).alias("pad"))
    got = hot.numbered(df, [F.col("k")], "place").agg(F.max("pad"), F.countDistinct("place").alias("d"), F.max("place").alias("m"), F.sum((F.col("place") != F.col("k") + 1).cast("int")).alias("bad")).first()
    assert (got.d, got.m, got.bad) == (n, n, 0)
