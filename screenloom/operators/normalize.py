"""Per-cell normalisation and cell filters."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def library_log1p(counts: DataFrame, floor: float | None = None, scale: float = 1e4, keep: list[str] = []) -> DataFrame:
    """``v = log1p(scale * cnt / total)`` per cell.

    ``floor`` replaces any total below it by 1; without it only a zero total is replaced.  ``keep``
    names further columns to carry along.  The window holds one cell, whose rows cannot exceed the gene universe.
    """
    total = F.sum("cnt").over(Window.partitionBy("cell_id"))
    bad = (F.col("total") < floor) if floor is not None else (F.col("total") == 0)
    return (
        counts.withColumn("total", total)
        .withColumn("total", F.when(bad, 1.0).otherwise(F.col("total")))
        .select("cell_id", "gene_idx", *keep, F.log1p(F.col("cnt") * F.lit(scale) / F.col("total")).alias("v"))
    )


def treated(cells: DataFrame, control: str, target="target") -> DataFrame:
    return cells.where(F.col(target) != F.lit(control))


def controls(cells: DataFrame, control: str, target="target") -> DataFrame:
    return cells.where(F.col(target) == F.lit(control))


def members_or_control(cells: DataFrame, listed: DataFrame, control: str, key="target") -> DataFrame:
    """Cells whose key is listed, and every control cell; the list joins, it is no literal IN."""
    marked = listed.select(key).unionByName(
        cells.sparkSession.range(1).select(F.lit(control).alias(key))
    ).distinct()
    return cells.join(marked, key, "left_semi")


def group_sizes(cells: DataFrame, keys: list[str], min_cells: int = 1) -> DataFrame:
    """n_cells per group, from the cell table so that cells without counts are included."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)
