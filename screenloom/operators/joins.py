"""Key joins with accounting."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from screenloom.operators.audit import key_sets


def bridge(left: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with their label where one exists."""
    return left.join(labels, keys, "left")


def bridge_report(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Matched and one-sided keys, duplicate keys and largest label disagreement, from one grouping
    of both sides by key."""
    v = F.col(value).cast("double")
    both = left.select(*keys, v.alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, v.alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per = both.groupBy(*keys).agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"),
        F.max(F.when(F.col("l") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("r") == 1, F.col("v"))).alias("b"),
    )
    l, rr = F.col("l"), F.col("r")
    return per.agg(
        F.count_if((l > 0) & (rr > 0)).alias("matched"), F.count_if((l > 0) & (rr == 0)).alias("left_only"),
        F.count_if((l == 0) & (rr > 0)).alias("right_only"), F.count_if(l > 1).alias("left_duplicates"),
        F.count_if(rr > 1).alias("right_duplicates"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_disagreement"),
    )


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one join.  A key missing or repeated on either side fails the query as the row is met:
    no row is dropped and nothing is counted beforehand."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full_outer")
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bad = F.col("_l").isNull() | F.col("_r").isNull() | (F.col("_n") != 1)
    msg = F.concat_ws(" ", F.lit("keys do not align at"), *[F.col(k).cast("string") for k in keys])
    ok = F.when(bad, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True))
    return both.withColumn("_n", n).where(ok).drop("_l", "_r", "_n")


def governed(df: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(population.select(*keys), keys, "left_semi")


def exclude_overlap(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen; ``seen`` is reduced to distinct keys before the shuffle."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def gather(index: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Values for every requested key; a key without a value fails the query."""
    j = index.join(values.withColumn("_hit", F.lit(True)), key, "left")
    miss = F.raise_error(F.concat(F.lit("no value for key "), F.col(key).cast("string"))).cast("boolean")
    return j.where(F.coalesce("_hit", miss)).drop("_hit")


__all__ = ["align", "bridge", "bridge_report", "exclude_overlap", "gather", "governed", "key_sets"]
