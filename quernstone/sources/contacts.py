"""Contact files: an array of objects or an object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "first_name string, last_name string, full_name string, phones array<string>"


def read(spark: SparkSession, path: str, *, is_array: bool | None = None) -> DataFrame:
    """Contacts with name: the full name, else first and last. The first line that isn't blank tells the two forms apart; lines are read in parallel."""
    if is_array is None:
        head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        is_array = bool(head) and head[0][0].lstrip().startswith("[")
    df = spark.read.schema(SCHEMA).option("multiLine", is_array).json(path)
    both = F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim("first_name"), F.lit("")), F.nullif(F.trim("last_name"), F.lit("")))), F.lit(""))
    return df.withColumn("name", F.coalesce(F.nullif(F.trim("full_name"), F.lit("")), both)).withColumn("pos", F.monotonically_increasing_id())
