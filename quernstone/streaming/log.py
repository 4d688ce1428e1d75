"""The log as a stream: files come in, new events are appended, views are replayed.

Appending is exactly-once by construction: a batch is written under its own id, replacing what a failed attempt of the
same batch left, and rows that the log has already are left out before. Views see any lateness, since they are folds
over the whole log; a watermark bounds state only in the windowed counts, which are approximate for events later than it.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from quernstone.plans.ledger import new_events, valid, with_ids


def source(spark: SparkSession, path: str, schema: StructType | str, *, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder of arriving files as a stream. Fewer files a batch is the backpressure; nothing is dropped."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def _log(spark: SparkSession, path: str, schema: StructType, batch: int) -> DataFrame:
    """What the log had before this batch, whatever a failed attempt of it left."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch_id") != batch)


class LimitReached(RuntimeError):
    """The log holds as many events as it may."""


#: Keys of a batch that go to the scan of the log; a larger batch is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def append(events: DataFrame, path: str, checkpoint: str, *, available_now: bool = True, max_events: int | None = None) -> StreamingQuery:
    """Appends a stream of events (seq, dedup_key, raw, source, event_type, ...) to the log at path/events, a folder a batch; rows that can't
    be appended go to path/rejected with their fault.

    max_events: once the log holds so many, the query fails with LimitReached before it takes the next batch. That batch is
    not committed: a query on the same checkpoint with more room goes on with it, and nothing is lost."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = valid(with_ids(batch))
        there = _log(spark, f"{path}/events", StructType.fromJson(good.withColumn("batch_id", F.lit(0)).schema.jsonValue()), batch_id)
        if max_events is not None and there.count() >= max_events:
            raise LimitReached(f"the log holds {max_events} events or more")
        # The keys of the batch go to the log, of which only two columns are read and nothing is shuffled.
        pair = ["dedup_key", "raw_hash"]
        keys = good.select(*pair).distinct()
        known = there.select(*pair).join(F.broadcast(keys) if batch.count() <= BROADCAST_KEYS else keys, pair, "left_semi")
        new_events(good, known).write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
        if bad.head(1):
            bad.write.mode("overwrite").parquet(f"{path}/rejected/batch_id={batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def deduplicated(events: DataFrame, *, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """The first of each (dedup_key, raw_hash) in a stream. With a delay the state is bounded, and a repeat later than it comes through again."""
    keys = ["dedup_key", "raw_hash"]
    if delay is None:
        return events.dropDuplicates(keys)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, *, ts: str = "ts", delay: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events by time window and the named columns."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, delay) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def notifications(events: DataFrame) -> DataFrame:
    """Events that a subscriber is told of: messages, receipts that were delivered, read or played, and typing."""
    kind, what = F.col("event_type"), F.get_json_object("payload", "$.kind")
    return events.filter((kind == "message") | ((kind == "receipt") & what.isin("delivered", "read", "played")) | ((kind == "presence") & what.isin("composing", "paused")))


class ProgressLog(StreamingQueryListener):
    """Progress of queries as JSON lines, one a minute at most, and their ends."""

    def __init__(self, path: str, every_seconds: float = 60.0):
        self.path, self.every, self.last = path, every_seconds, float("-inf")

    def _write(self, event: str, **data) -> None:
        now = datetime.now(UTC)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"event": event, "ts": int(now.timestamp() * 1000), **data}) + "\n")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._write("started", id=str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        now = datetime.now(UTC).timestamp()
        if now - self.last >= self.every:
            self.last = now
            self._write("progress", batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write("ended", id=str(event.id), error=event.exception)
