"""Windows over keys that may hold a large share of all rows.

A window over a key sorts all of the key's rows in one task. Here a key's rows are cut into buckets of its order column;
windows run over (key, bucket), and a table of one row a bucket carries what passes from bucket to bucket. Both sides
of the join between them are partitioned alike, so that rows are shuffled once, as for the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in the unit of the order column: a day in seconds.
WIDTH = 86_400
BUCKET = "__bucket"


def bucketed(df: DataFrame, by: str, width: int = WIDTH) -> DataFrame:
    """df with its bucket; null goes before all others, as it is sorted."""
    return df.withColumn(BUCKET, F.coalesce(F.floor(F.col(by) / width), F.lit(-(2**62))).cast("bigint"))


def _neighbour(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: int, ahead: bool) -> DataFrame:
    rows = bucketed(df, order[0], width).withColumn("__v", value)
    up, down = [F.col(c) for c in order], [F.col(c).desc() for c in order]
    near = rows.groupBy(key, BUCKET).agg((F.min_by if ahead else F.max_by)("__v", F.struct(*order)).alias("__n"))
    across = near.withColumn("__across", F.lead("__n").over(Window.partitionBy(key).orderBy(F.col(BUCKET) if ahead else F.col(BUCKET).desc()))).drop("__n")
    inside = F.lead("__v").over(Window.partitionBy(key, BUCKET).orderBy(*(up if ahead else down)))
    last = F.row_number().over(Window.partitionBy(key, BUCKET).orderBy(*(down if ahead else up))) == 1
    out = rows.withColumns({"__inside": inside, "__last": last}).join(across, [key, BUCKET])
    return out.withColumn(name, F.when(F.col("__last"), F.col("__across")).otherwise(F.col("__inside"))).select(*df.columns, name)


def following(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the value of the key's next row by order; order begins with the column that makes the buckets."""
    return _neighbour(df, key, order, value, name, width, True)


def preceding(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the value of the key's row before by order."""
    return _neighbour(df, key, order, value, name, width, False)


def running_count(df: DataFrame, key: str, order: list[str], counted: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the number of counted rows of the key up to and with this one."""
    rows = bucketed(df, order[0], width).withColumn("__c", counted.cast("bigint"))
    totals = rows.groupBy(key, BUCKET).agg(F.sum("__c").alias("__t"))
    ahead = totals.withColumn("__ahead", F.coalesce(F.sum("__t").over(Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inside = F.sum("__c").over(Window.partitionBy(key, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(ahead, [key, BUCKET]).withColumn(name, F.col("__ahead") + F.col("__inside")).select(*df.columns, name)


def latest(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the last value that is not null among the key's rows before this one by order."""
    rows = bucketed(df, order[0], width).withColumn("__v", value)
    ends = rows.groupBy(key, BUCKET).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__e"))
    before = Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__e", ignorenulls=True).over(before)).drop("__e")
    inside = F.last("__v", ignorenulls=True).over(Window.partitionBy(key, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__inside", inside).join(carried, [key, BUCKET]).withColumn(name, F.coalesce("__inside", "__carried")).select(*df.columns, name)


def frame_count(df: DataFrame, key: str, order: list[str], before: int, after: int, name: str, width: int = WIDTH) -> DataFrame:
    """df with the number of the key's rows from so many before to so many after each, itself too: from its place and the key's size, without a frame."""
    placed = running_count(df, key, order, F.lit(True), "__place", width)
    sizes = df.groupBy(key).agg(F.count("*").alias("__size"))
    around = F.least(F.col("__place") - 1, F.lit(before)) + 1 + F.least(F.col("__size") - F.col("__place"), F.lit(after))
    return placed.join(sizes, key).withColumn(name, around.cast("bigint")).select(*df.columns, name)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """df with each row's number by order over all rows: sorted by ranges, each range numbered by itself, and one total a range goes to all."""
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    ahead = F.broadcast(counts.withColumn("__a", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n"))  # a row a range
    number = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.join(ahead, "__p").withColumn(name, (number + F.col("__a") + (first - 1)).cast("bigint")).drop("__p", "__a")
