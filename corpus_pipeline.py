"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir). `run` writes what a stage returns as Parquet and
gives it, read again, to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm import decontaminate, mixing, quality_gam, secret_scan, simhash
from tracklight.llm.common import table
from tracklight.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: 4-word shingles, at most 4 differing bits."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars counted anew."""
    return secret_scan.without_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each epoch of each document that the mix takes, the last one cut."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: SQL cannot express the classifier, SimHash and tiling; tests replay the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixed corpus, which the last stage makes of all documents, takes of those before it."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
    return mixing.taken_words(before, docs)
