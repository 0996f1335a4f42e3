"""The training-corpus pipeline: language identification, near-duplicates, decontamination, mixing, sharding.

Each stage takes all that its predecessor kept, is written as Parquet and read again by the next. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, language_id, mixing, sharding, similar
from quillgrid.llm.common import row_key, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter, null and empty texts go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five words, similarity 0.8) one row: that of the smallest doc_id, null last,
    then of the smallest key."""
    keyed = docs.withColumn("__row", row_key(docs))
    place = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
    found = similar.similar_documents(keyed.select(place.alias("place"), "text"), id_col="place")
    keep = found.select(F.col("component_id.row").alias("__row")).distinct()
    return keyed.join(keep, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly benchmark text goes."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    keyed = docs.withColumn("__row", row_key(docs))
    taken = mixing.mix(keyed, id_col="__row").where("taken > 0")
    taken = taken.groupBy("__row").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    held = keyed.dropDuplicates(["__row"]).join(taken, "__row")
    return held.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_texts),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: Network, fingerprints and rounds have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the cluster's shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
