"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quernstone import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "NULL" if v != v else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = oracle.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_reruns_agree(spark, name):
    """What SQL can't say has rows, and the same ones again with other partitions."""
    rows = lambda: sorted(str(r) for r in queries.QUERIES[name](spark, SF).collect())
    first = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert first and rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
