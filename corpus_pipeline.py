"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, as a table read from Parquet, and returns what it
keeps with the columns of ``documents``; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import decontamination, line_dedup, ngram_jaccard, packing, quality_classifier
from glyphflow.llm.storage import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all of them and the labels, accepts."""
    scored = quality_classifier.classify(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix="__quality_")
    return scored.where("__quality_accepted").select([F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier one has; those of which nothing is left go."""
    return line_dedup.clean(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is the benchmark's."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot train the classifier or run the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
