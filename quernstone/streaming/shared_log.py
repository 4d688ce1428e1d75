"""One log for several streams: gapless sequence numbers, batches that are recognised when they are sent again.

A batch is written into a folder of its own, which nobody reads before a numbered commit names it. A commit is created only if
absent, so that of two streams that come at once one is second: it looks again at what is known now, and numbers its rows
anew from the new head. A commit holds the head and the last batch of every stream; the last commit says all that a writer needs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.plans.ledger import new_events, valid, with_ids
from quernstone.sources.catalog import Conflict, create_once, durable, last_number, numbered

PAIR = ("dedup_key", "raw_hash")
COMMIT = "number bigint, stream string, batch bigint, folder string, first bigint, rows bigint, head bigint"
#: A batch that loses so many times against other streams fails; it can be sent again.
ATTEMPTS = 20


def head(spark: SparkSession, path: str) -> dict:
    """number (of the last commit), head (the greatest sequence number), streams (the last batch of each)."""
    number = last_number(spark, f"{path}/commits")
    empty = {"number": 0, "head": 0, "streams": {}}
    return json.loads(spark.read.text(numbered(f"{path}/commits", number), wholetext=True).first()[0]) if number else empty


def commits(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(number, stream, batch, folder, first, rows, head) of each commit, or of the first so many; folder is null for a batch that added nothing."""
    if not last_number(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT)
    found = spark.read.schema(COMMIT).json(f"{path}/commits/*.json")
    return found.filter(F.col("number") <= upto) if upto is not None else found


def read(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The events of all commits, or of the first so many; None while there are none. Columns that only some batches have are null in the others."""
    folders = [f"{path}/events/{r.folder}" for r in commits(spark, path, upto).filter("folder IS NOT NULL").select("folder").collect()]  # a name a batch
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def _numbered(fresh: DataFrame, order: str, first: int) -> DataFrame:
    """fresh with seq from first on, by order, then key. The rows of each range are written down with the range's number, so that counts and rows can't disagree."""
    by = [F.col(order), F.xxhash64(*PAIR), *map(F.col, PAIR)]
    parts = durable(fresh.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "ranges")
    ahead = parts.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__a", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*by))
    out = parts.join(F.broadcast(ahead.drop("__n")), "__p")  # a row a range
    return out.withColumn("seq", (place + F.col("__a") + (first - 1)).cast("bigint")).drop("__p", "__a")


def append_batch(events: DataFrame, path: str, stream: str, batch: int, *, order: str = "arrival") -> int:
    """Appends one batch (dedup_key, raw, source, event_type, order, ...) of a stream; the number of rows added.

    A stream's batches have rising numbers; one that is not above the stream's last adds nothing, whatever it holds. Of rows with equal
    key and bytes the first by order is taken, of those that the log has none. seq goes on from the head without a gap, in the batch by order (null first, ties by a hash of the key);
    a column seq of the input is replaced. Rows that can't be appended go to path/rejected with their fault. An empty batch is committed too."""
    spark = events.sparkSession
    good, bad = valid(with_ids(events.drop("seq")))
    own = f"{stream}-{batch}-{uuid.uuid4().hex}"
    for attempt in range(ATTEMPTS):
        now = head(spark, path)
        if batch <= now["streams"].get(stream, -1):
            return 0
        if not attempt:
            good = durable(new_events(good, order=order), "batch")
            if bad.head(1):  # a batch's folder is replaced by what a second attempt of it finds
                bad.write.mode("overwrite").parquet(f"{path}/rejected/stream={stream}/batch={batch}")
        log = read(spark, path, now["number"])
        fresh = good if log is None else good.join(log.select(*PAIR).join(good.select(*PAIR), list(PAIR), "left_semi"), list(PAIR), "left_anti")
        made = f"{own}-{attempt}"
        _numbered(fresh, order, now["head"] + 1).write.parquet(f"{path}/events/{made}")
        rows = spark.read.parquet(f"{path}/events/{made}").count()
        commit = {
            "number": now["number"] + 1, "stream": stream, "batch": batch, "folder": made if rows else None, "first": now["head"] + 1 if rows else None, "rows": rows,
            "head": now["head"] + rows, "streams": now["streams"] | {stream: batch},
        }
        if create_once(spark, numbered(f"{path}/commits", now["number"] + 1), json.dumps(commit)):
            return rows
    raise Conflict(f"batch {batch} of {stream} lost {ATTEMPTS} times against other streams")


def append(events: DataFrame, path: str, stream: str, checkpoint: str, *, order: str = "arrival", available_now: bool = True) -> StreamingQuery:
    """append_batch for each batch of a stream. The checkpoint belongs to the stream's name: a new one needs another name."""
    writer = events.writeStream.foreachBatch(lambda df, batch: append_batch(df, path, stream, batch, order=order) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
