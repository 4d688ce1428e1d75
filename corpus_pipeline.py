"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read by the next. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import language_id, mixing, near_dedup, sharding
from quernstone.llm.decontaminate import decontaminate
from quernstone.llm.store import scratch, shared_dir

#: A text of so many letters (bytes) is rejected if so large a share of it reads as no language.
LETTERS, NOISE = 200, 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: no text, no letters, or mostly letters that the network reads as noise.
    Short texts are not judged by that: a few letters are too little evidence."""
    names = ("__lang_pred", "__lang_score", "__noise", "__letters_n")
    marked = language_id.with_language(docs, language_id.fit(docs, F.lit(True)), names=names)
    und, _, noise, letters = map(F.col, names)
    return marked.filter((und != language_id.UND) & ~((letters >= LETTERS) & (noise > NOISE))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id."""
    return near_dedup.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_coverage=0.0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, 0 to 7."""
    return sharding.with_shard(docs, 8)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("source_mix", mix_sources),
    ("sharding", cut_shards),
]

#: Neither the network nor the signatures can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage writes down on its way goes once its result stands
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
