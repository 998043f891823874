"""Bounded samples of labelled rows for the classifiers, and the held-out folds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(modulus))


def sample(labels: DataFrame, target: str, train: Column, most: int) -> DataFrame:
    """At most ``most`` labelled training ids with their label ``y``, in the order of a hash of the id.

    Rows without id or label are left out; repeated labels of an id are averaged."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("double").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & train)
    return rows.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows (bounded by :func:`sample`, hence broadcast) with their texts."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
