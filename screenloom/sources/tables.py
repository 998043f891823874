"""Reading and writing of screen tables."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F


_SCHEMAS: dict[str, object] = {}


def read(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One Parquet table; ``columns`` limits the scan to what the caller names.

    The schema is taken from the file footers once per path; files are listed afresh each time."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return df.select(*columns) if columns else df


def read_rows(df: DataFrame, batch: str, control: str, batch_col="batch", target_col="target") -> DataFrame:
    """Treated cells of one batch; both tests reach the scan as pushed filters."""
    return df.where((F.col(batch_col) == batch) & (F.col(target_col) != control))


def read_list(spark: SparkSession, path: str, schema: str, eligible: str | None = None) -> DataFrame:
    """A CSV list of constructs or targets with a stated schema, optionally only eligible rows."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.where(F.col(eligible)) if eligible else df


def pack_columns(df: DataFrame, pattern: str, name: str, keep: list[str]) -> DataFrame:
    """Flat numbered columns to one array, in the order of their numeric suffix."""
    hits = [c for c in df.columns if re.fullmatch(pattern, c)]
    if not hits:
        raise ValueError(f"no column matches {pattern}")
    hits.sort(key=lambda c: int(re.search(r"(\d+)$", c).group(1)))
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in hits]).alias(name))


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Long result table, one row per (arm, screen, metric), as parquet, json or csv."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def as_document(df: DataFrame, keys: list[str], name: str = "doc") -> DataFrame:
    """Each row as a JSON document beside its keys."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))
