"""Tables written once and read many times, in the folder all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch. Texts of a batch are cut further by bytes inside the tasks.
ARROW_ROWS, ARROW_BYTES = 400, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a folder of this machine if Spark runs in this
    process alone (tests), else an error: executors elsewhere would not see such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return named.rstrip("/")


#: Tables written within each open scratch().
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that durable() writes within it. For whoever writes down a result inside: one that is only planned needs them still."""
    _scratch.append([])
    try:
        yield
    finally:
        path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _scratch.pop():
            path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_of(path), True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here and a lost
    executor costs no recomputation. The files stay until a scratch() around it ends, or the folder of the application is removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of a batch, and so the memory of a Python worker, for the session: a lazy result is only
    planned when its caller runs it, so that the settings can't be put back here. Smaller ones are left alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = re.match(r"\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else the input carries, under whatever name, can't clash."""
    return df.select(*[df[n] for n in names])
