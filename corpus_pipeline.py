"""The corpus pipeline: documents → a sharded training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveykit.llm import decontam, mixing, ngram_join, sharding, toxicity
from surveykit.llm.common import table, temp_name
from surveykit.llm.queries import SHARDS
from surveykit.session import scratch_path, ship_code

#: Near duplicates share words in fives, at a similarity of 0.8 or more.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Whole texts go to Python workers in batches of so many bytes at most (or one long text).
BATCH_BYTES = 2 << 20


def _ready(spark: SparkSession) -> None:
    """The session as the Python stages need it: code shipped, batches bounded by bytes."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under one half stay (a null text does)."""
    _ready(spark)
    model = toxicity.fit(toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    score = temp_name(docs, "score")
    return (docs.withColumn(score, toxicity.score_column(model, F.col("text")))
            .where(F.col(score) < 0.5).drop(score))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Documents without a word have no group and all stay; of repeated rows with the group's
    smallest id one stays, as of groups without any id.
    """
    _ready(spark)
    return ngram_join.one_of_each(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    _ready(spark)
    found = temp_name(docs, "passages")
    return (decontam.find_passages(docs, table(spark, sf_dir, "benchmark"), found)
            .where(F.size(found) == 0).drop(found))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.assign_shards(docs, SHARDS, "doc_id", F.col("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Fitted models and similarity components have no SQL form; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
