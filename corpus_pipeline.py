"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

Each stage takes all that its predecessor kept, with whatever columns there are besides doc_id, text
and source, and decides row by row: rows that repeat an id are judged each on their own text, null
ids included. An empty table goes through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import shared_dir
from chronoloom.llm.decontaminate import decontaminate
from chronoloom.llm.mixing import mixed
from chronoloom.llm.neardup import keep_one
from chronoloom.llm.sharding import shuffle_to_shards
from chronoloom.llm.toxicity import drop_toxic, train
from chronoloom.ship import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that operator 2 predicts toxic. Null and empty texts are scored as empty ones;
    very long texts are read whole; equal texts share their fate."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies by five-word shingles: that of the smallest doc_id. Rows without words,
    and rows of a null doc_id, stay; repeated rows of a kept doc_id all stay."""
    return keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark. Null and empty texts hold none; very long texts
    are searched whole."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs as often as the mixture of sources takes them; a null source is a source of its own. A row
    without words is never taken; ties of a key go by doc_id and a hash of the text."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot: eight shards whose counts differ by one at most. Rows are told apart by doc_id
    and text, repeated ones by a running number; null ids and texts are values."""
    return shuffle_to_shards(docs, key=("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Compression, random signatures and drawn counts have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
