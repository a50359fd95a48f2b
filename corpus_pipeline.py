"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all that its predecessor kept.  The first four give back rows of `documents` with its columns; the last
gives one row per piece of a packed sequence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from votelens.llm import decontaminate, exact, packing, simhash, toxicity
from votelens.llm.common import shared_dir, table, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Compression distances, fingerprints and tokens are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet to the shared folder and read again.

    The stages' files go when the application ends.
    """
    path = temporary(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
