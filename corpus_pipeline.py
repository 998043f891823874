"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, secrets, mixing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenloom.llm import circulant, latent, mixing, secrets, winnow
from screenloom.session import durable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return latent.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: texts linked at a Jaccard similarity of 0.8 or more on five-word shingles.

    With 42 bands a pair at 0.8 meets in none with probability (1 - 0.8**5)**42 = 6e-8."""
    return circulant.drop_duplicates(docs, bands=42, least=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return winnow.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selected documents with all their columns, texts masked as they came, and in ``epochs`` how often each is taken."""
    return mixing.mixed(docs, weights=mixing.WEIGHTS)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masking),
    ("source mixing", mixture),
]

#: The classifier and the signatures have no SQL form; the tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
