"""Contiguous shards of near equal bytes, by prefix sums from per-partition totals.

A row's size is the UTF-8 bytes of its text (a null text has none) plus one. Rows are ordered by id, then by the
checksum of the text and the size; they are dealt by range into sorted partitions; each partition's total gives
the sum ahead of the next, so that the sum ahead of every row is known without one task seeing all. With n
shards, a row whose middle falls into the k-th of n equal parts of all bytes goes to shard k: each shard's
bytes differ from its equal part by one row at most.

Rows equal in everything are alike, and either may come first. A null id comes first. Texts that occur twice
are two rows like any other: bytes are the only law. An empty table has no rows and no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.store import durable

SHARDS = 8
_ORDER = ("doc_id", "crc", "size")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _ahead(totals: DataFrame, by: list[str], values: list[str], within: list[str]) -> DataFrame:
    """Exclusive prefix sums over a table with a row a partition."""
    w = (Window.partitionBy(*within) if within else Window).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, *within, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{v}_ahead") for v in values])


def place(docs: DataFrame, shards: int = SHARDS, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, crc, shard, slot (from 0 within the shard)."""
    spark = docs.sparkSession
    narrow = docs.select(docs[doc_col].alias("doc_id"), size_of(docs[text_col]).alias("size"), crc_of(docs[text_col]).alias("crc"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(narrow.repartitionByRange(parts, *_ORDER).withColumn("part", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # A row a partition: the table's size is set by the number of partitions.
    ahead = durable(_ahead(totals, ["part"], ["bytes", "rows"], []), "ahead")
    total = dealt.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    run = Window.partitionBy("part").orderBy(*_ORDER)
    start = F.col("bytes_ahead") + F.coalesce(F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("rows_ahead") + F.row_number().over(run) - 1
    shard = F.least(F.lit(shards - 1), F.floor((2 * F.col("start") + F.col("size")) * shards / F.lit(2 * total))).cast("int")
    rows = durable(dealt.join(F.broadcast(ahead), "part").withColumns({"start": start, "number": number}).select("doc_id", "size", "crc", "number", shard.alias("shard")), "placed")
    first = rows.groupBy("shard").agg(F.min("number").alias("first"))  # a row a shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "crc", "shard", (F.col("number") - F.col("first")).cast("bigint").alias("slot"))


def assignments(docs: DataFrame, shards: int = SHARDS, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes)."""
    out = place(docs, shards, doc_col=doc_col, text_col=text_col)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = SHARDS, *, doc_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """docs in its own columns with the shard of each row behind them. Rows find their shard by comparing
    themselves with the last row of each shard, so that texts aren't moved; rows equal in everything stay together."""
    placed = durable(place(docs, shards, doc_col=doc_col, text_col=text_col), "placed")
    lasts = placed.groupBy("shard").agg(F.max(F.struct(*_ORDER)).alias("last")).orderBy("shard").collect()  # a row a shard
    own = F.struct(docs[doc_col].alias("doc_id"), crc_of(docs[text_col]).alias("crc"), size_of(docs[text_col]).alias("size"))
    found = F.lit(lasts[-1]["shard"] if lasts else 0)
    kind = docs.schema[doc_col].dataType
    for row in reversed(lasts[:-1]):
        last = F.struct(F.lit(row["last"]["doc_id"]).cast(kind).alias("doc_id"), F.lit(row["last"]["crc"]).cast("bigint").alias("crc"), F.lit(row["last"]["size"]).cast("bigint").alias("size"))
        found = F.when(own <= last, F.lit(row["shard"])).otherwise(found)
    return docs.select(*[docs[c] for c in docs.columns], found.cast("int").alias(name))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **columns: str) -> None:
    """Writes a folder for each shard, its rows in order of id within each file."""
    placed = with_shard(docs, shards, **columns)
    doc_col = columns.get("doc_col", "doc_id")
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(parts, "shard", doc_col).sortWithinPartitions("shard", doc_col).write.partitionBy("shard").parquet(path)
