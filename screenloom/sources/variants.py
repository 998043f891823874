"""Partitioned profile variants with a checked description."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TRANSFORMS = ("raw", "delta")
SELECTIONS = ("hvg", "crossctx", "all")
VERSION = 1


class ForbiddenVariant(ValueError):
    """A variant or gene list that must not be read."""


def variant_path(
    root: str,
    transform: str,
    selection: str,
    forbidden: tuple[tuple[str, str], ...] = (("raw", "hvg"),),
    gene_list: str | None = None,
    authoritative: str | None = None,
) -> str:
    """Folder of a variant; raises before any read for unknown or forbidden ones."""
    if transform not in TRANSFORMS or selection not in SELECTIONS:
        raise ValueError(f"unknown variant {transform}/{selection}")
    if (transform, selection) in forbidden:
        raise ForbiddenVariant(f"variant {transform}/{selection} is not authoritative")
    if authoritative is not None and gene_list != authoritative:
        raise ForbiddenVariant(f"gene list {gene_list!r} is not {authoritative!r}")
    return f"{root}/{transform}_{selection}"


def write_variant(df: DataFrame, path: str, transform: str, selection: str, n_genes: int) -> None:
    """Profiles by split and batch, and one row that says how they were made."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy("split", "batch").parquet(f"{path}/profiles")
    meta = spark.range(1).select(
        F.lit(VERSION).alias("version"),
        F.lit(transform).alias("transform"),
        F.lit(selection).alias("selection"),
        F.lit(n_genes).alias("n_genes"),
    )
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_variant(spark: SparkSession, path: str, transform: str, selection: str, n_genes: int) -> DataFrame | None:
    """Stored profiles; ``None`` when absent or of an older version, an error on a mismatch.

    Partition columns keep their string type: inference would turn a batch named ``1996`` into a
    number and break key equality with the cell table.
    """
    if not _exists(spark, f"{path}/meta/_SUCCESS"):
        return None
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION:
        return None
    found = (meta["transform"], meta["selection"], meta["n_genes"])
    if found != (transform, selection, n_genes):
        raise ValueError(f"stored variant {found} is not {(transform, selection, n_genes)}")
    stored = spark.read.parquet(f"{path}/profiles")
    fields = [f for f in stored.schema.fields if f.name not in ("split", "batch")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return spark.read.schema(f"{schema}, split string, batch string").parquet(f"{path}/profiles")


def reuse_variant(spark, root, transform, selection, n_genes, build, forbidden=(("raw", "hvg"),)) -> DataFrame:
    """Read the stored variant or build and store it."""
    path = variant_path(root, transform, selection, forbidden)
    stored = read_variant(spark, path, transform, selection, n_genes)
    if stored is not None:
        return stored
    write_variant(build(), path, transform, selection, n_genes)
    return read_variant(spark, path, transform, selection, n_genes)
