"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Every stage takes null and empty texts, null and repeated identifiers, ties, very long texts, other columns of any name
and an empty table as its operator's module states. What a stage wrote is deleted when the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, mixing, packing, simhash, toxicity
from corvane.llm.common import ready


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network judges toxic go; it learns from the labels of this run's documents."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity (0.8 of their distinct 5-word shingles) the one with the smallest identifier stays."""
    return simhash.dedup_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share wants it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(packing.pieces(docs)).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Stages that learn, hash with XXH64 and tokenise have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared checkpoint folder."""
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # what the next stage has read is not needed any more
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
