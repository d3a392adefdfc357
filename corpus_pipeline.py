"""Cleaning and packing of documents, by five of the corpus operators.

Each stage works on all that the one before it kept: documents that the quality
classifier rejects go; one document of each near-duplicate group stays;
documents that contain a benchmark item go; personal data gets surrogates; the
rest is packed into sequences.

Defined cases: a null or empty text is scored as no bytes, and one of them at most
is left by the second stage; of repeated rows one stays; an empty table gives an
empty table; other columns stay up to the last stage, whatever their names; rows
without an id are kept or dropped by their texts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesengine.llm import decontaminate, packing, pii, quality, simhash
from salesengine.llm.queries import PII_KEY, tokenizer_path
from salesengine.session import reliable_checkpoint


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer_path())).drop("copy")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII surrogates", without_personal_data),
    ("best-fit packing", packed),
]

#: Scores, fingerprints and tokens aren't SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir))
    return docs
