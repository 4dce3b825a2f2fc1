"""The corpus pipeline: documents to a mix, in five stages, each written as Parquet and read again.

Every stage works on all that the one before it kept. The first four return the
columns that they are given, those of documents and any others; the last returns
the mix, one row for each document that it takes: doc_id, source, size,
source_size, target, copies, taken. Null texts are judged as empty ones; rows that
repeat go with the near duplicates; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import decontaminate, line_dedup, mixing, near_dup, quality_model
from tideframe.llm.common import Written

def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    left = line_dedup.drop_lines(docs, "source", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of least doc_id."""
    return near_dup.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within the allowed edits, go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words."""
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("near duplicates", dedup_documents),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: The classifier, the sampled bands and the cube method have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table goes as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made = Written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before:
            before.drop()
        docs, before = made.df, made
    return docs
