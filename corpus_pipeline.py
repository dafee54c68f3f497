"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept. All but the last return the columns of the documents; the
last returns the sampling rate of every document that is left. Nulls, empty texts, ties, repeated rows, empty
tables and extra columns are treated as the docstring of each operator says; ``n_chars`` follows the
shortened text after line dedup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairload.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from fairload.llm.common import table, written
from fairload.session import ship as shipped

#: Texts are long: rows that go to a Python worker at a time, in each of its batches.
BATCH_ROWS = 1_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Target shares of expected tokens by text domain.
TARGETS = {"en": 0.45, "de": 0.18, "fr": 0.18, "es": 0.17, "junk": 0.02}


def ship(spark: SparkSession) -> None:
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    left = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.text_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, TARGETS, keep=["doc_id", "source", "lang"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
]

#: Fitted classifiers and fingerprints have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
