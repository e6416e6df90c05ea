"""The training-data pipeline: five stages over the documents, each written and read again.

Quality rules, near-duplicates, decontamination, mixing, sharding. Every stage sees all that the one
before it kept and returns the columns of documents; the last adds size, text_crc32, law, shard,
slot and grown_shard.

Defined results: null and empty texts have no words and fail the base quality rule; null ids are
never near-duplicates of anything; of several rows of an id the one of least text digest stays; a null lang
is a stratum and a branch of the mix of its own; texts that hold nothing but benchmark passages go;
very long texts are taken whole; rows that the mix takes in two epochs stand twice; ties are broken by digest; columns of
any name are carried, and the last stage's own take a leading underscore where they clash; empty tables
of labels or benchmark change nothing, no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, minhash_dedup, mixing, quality_rules, sharding
from plumbline.llm.shared import discard, scratch

#: In near-duplicate stages: five words a shingle.
NEAR = minhash_dedup.Settings(shingle=5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, law="bytes")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL has neither the signatures nor the exact tests; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; what a stage returns is written to the shared folder and read again, and deleted once the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        place = scratch(spark, f"stage-{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if last:
            discard(spark, last)
        last = place
    return docs
