"""A training-corpus pipeline: five of the text operators in a row, each over all that its predecessor kept.

Every stage but the last returns the columns of ``documents``.  Rows without a ``doc_id``
stay in the near-duplicate stage, which cannot group them; the other stages judge texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricframe.llm import bpe, decontaminate, entries, langid, secrets, simhash
from metricframe.llm.storage import importable, materialize, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without a letter, and those that score below the calibrated threshold.

    The model learns from the stage's own input, as the query for language ID does.
    """
    importable(spark)
    model = langid.train(docs.filter(entries.fold() != 1).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).filter("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the smallest ``doc_id`` stays."""
    importable(spark)
    return simhash.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    importable(spark)
    return decontaminate.without_leaks(docs, entries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked, and ``n_chars`` counts the text that is left."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *docs.columns
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each remaining text: counts and digests of ids and round trip."""
    importable(spark)
    return bpe.round_trip_digests(docs, entries.RANKS, entries.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

#: SQL cannot express the trained, hashed and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
