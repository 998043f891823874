"""Ordered running sums, ordinals and ranks that do not need a whole group in one task.

A window over a group is the cheapest plan while the group fits one task.  Beyond ``limit`` rows
the same numbers come from a range-partitioned prefix sum: rows are split by
``repartitionByRange(keys, order)``, each slice sums on its own, and the slices' offsets (one row
per key and slice) are joined back.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.session import durable

GROUP_LIMIT = 2_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def fits(df: DataFrame, keys: list[str], limit: int | None) -> bool:
    """True when every group of ``df`` has at most ``limit`` rows.  ``None`` states that they do, 0
    that they do not; neither costs a count."""
    if limit == 0:
        return False
    return limit is None or largest_group(df, keys) <= limit


def path(df: DataFrame, keys: list[str], limit: int | None = GROUP_LIMIT) -> int | None:
    """One size check for several ranked columns: the limit to pass on, ``None`` when every group
    fits one task and 0 when the range path is needed."""
    return None if fits(df, keys, limit) else 0


def _part(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: list[str],
    limit: int | None = GROUP_LIMIT,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add ``<s>_before`` (sum over earlier rows) and ``<s>_total`` for each column in ``sums``.

    ``(keys, order)`` must identify a row: aggregate ties first.  ``bound`` is a cheaper frame
    whose group sizes are not below those of ``df``.
    """
    if fits(bound if bound is not None else df, keys, limit):
        w = _part(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = df
        for s in sums:
            out = out.withColumn(f"{s}_before", F.coalesce(F.sum(s).over(w), F.lit(0).cast(_type(df, s))))
        for s in sums:
            out = out.withColumn(f"{s}_total", F.sum(s).over(_part(keys)))
        return out
    return _running_by_range(df, keys, order, sums)


def _type(df: DataFrame, col: str) -> str:
    t = df.schema[col].dataType.simpleString()
    return "double" if t in ("double", "float") else "bigint"


def _running_by_range(df, keys, order, sums) -> DataFrame:
    spark = df.sparkSession
    slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = _part(keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[
            F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0).cast(_type(df, s))).alias(f"_o_{s}")
            for s in sums
        ],
        *[F.sum(f"_t_{s}").over(_part(keys)).alias(f"{s}_total") for s in sums],
    )
    local = ranged
    for s in sums:
        local = local.withColumn(f"_l_{s}", F.coalesce(F.sum(s).over(inner), F.lit(0).cast(_type(df, s))))
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_slice") == F.col("_k_slice"),
    )
    joined = local.join(totals, on)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def ordinal(df, keys, order, name="ordinal", limit=GROUP_LIMIT, bound=None) -> DataFrame:
    """Zero-based position inside the group; ``(keys, order)`` must be unique."""
    out = running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, ["_one"], limit, bound)
    return out.withColumnRenamed("_one_before", name).withColumnRenamed("_one_total", f"{name}_n").drop("_one")


def average_rank(
    df: DataFrame,
    keys: list[str],
    values: dict[str, str],
    limit: int | None = GROUP_LIMIT,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Ranks 1..n with ties at their mean rank; ``values`` maps output name to value column."""
    if fits(bound if bound is not None else df, keys, limit):
        out = df
        for name, v in values.items():
            # ties come from a peer frame of the same ordering, so each column is sorted once
            w = _part(keys).orderBy(v)
            lead = F.rank().over(w)
            same = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
            out = out.withColumn(name, lead + (same - 1) / F.lit(2.0))
        return out
    out = df
    for name, v in values.items():
        ties = df.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_n"))
        ranks = running(ties, keys, [v], ["_n"], limit)
        ranks = ranks.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col(v).alias("_k_value"),
            (F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(name),
        )
        on = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
            F.col(v).eqNullSafe(F.col("_k_value")),
        )
        out = out.join(ranks, on).drop("_k_value", *[f"_k_{k}" for k in keys])
    return out


def weighted_rank(df, keys, value, weight, name, limit=GROUP_LIMIT, bound=None) -> DataFrame:
    """Average-tie rank of ``value`` when each row stands for ``weight`` equal rows."""
    if fits(bound if bound is not None else df, keys, limit):
        w = _part(keys).orderBy(value)
        upto = F.sum(weight).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        tie = F.sum(weight).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return df.withColumn(name, upto - tie + (tie + 1) / F.lit(2.0))
    ties = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    ranks = running(ties, keys, [value], ["_w"], limit)
    ranks = ranks.select(
        *keys, value, (F.col("_w_before") + (F.col("_w") + 1) / F.lit(2.0)).alias(name)
    )
    return df.join(ranks, [*keys, value])
