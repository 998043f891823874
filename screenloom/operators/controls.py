"""Capacity and alignment controls.  None of these takes a label: draws depend on row keys only."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from screenloom.functions.hashing import normal, normals, order_key
from screenloom.functions.ordered import GROUP_LIMIT, ordinal

# The stream number added to a control's seed for each split or screen.
SPLIT_INDEX = {"train": 0, "val": 1, "test": 2, "RPE1": 3, "K562": 4}
# Seeds of the five control arms, apart from the model seeds 0, 1, 2.
SEEDS = {"C1": 20270101, "C2": 20270102, "C3": 20270103, "C4": 20270104, "C5": 20270105}


def split_seed(seed: int, split="split") -> Column:
    """Seed plus the split's stream number; an unknown split fails the query."""
    stream = F.create_map(*[x for k, v in SPLIT_INDEX.items() for x in (F.lit(k), F.lit(v))])[F.col(split)]
    known = F.coalesce(stream, F.raise_error(F.concat(F.lit("unknown split "), F.col(split))).cast("int"))
    return F.lit(seed) + known


def noise(key: str, dim: int, seed: int, split="split") -> Column:
    """A vector of independent standard normals per row."""
    return normals(split_seed(seed, split), F.col(key), dim)


def projection_matrix(spark, x_dim: int, out_dim: int, seed: int = SEEDS["C2"]):
    """The one fixed matrix with entries N(0, 1/out_dim): x_dim * out_dim numbers, whatever the data."""
    e = spark.range(x_dim * out_dim).select(
        "id", (normal(seed, F.floor(F.col("id") / out_dim) + 1, F.col("id") % out_dim + 1) / math.sqrt(out_dim)).alias("r")
    )
    return e.orderBy("id").toPandas()["r"].to_numpy().reshape(x_dim, out_dim)


def project(df: DataFrame, col: str, matrix, name: str) -> DataFrame:
    """Multiply each row's vector by the broadcast matrix, one Arrow batch at a time."""
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    def times(x):
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(x.to_numpy()) @ shared.value))

    return df.withColumn(name, pandas_udf(times, "array<double>")(F.col(col)))


def shuffled(df: DataFrame, key: str, cols: list[str], seed: int, split="split", limit=GROUP_LIMIT) -> DataFrame:
    """Rows of ``df`` whose ``cols`` come from another row of the same split: a keyed permutation."""
    ids = df.select(split, key, order_key(split_seed(seed, split), F.col(key)).alias("_o"))
    place = ordinal(ids.drop("_o"), [split], [key], "_p", limit).drop("_p_n")
    source = ordinal(ids, [split], ["_o"], "_p", limit).drop("_p_n", "_o")
    pairs = place.join(source.withColumnRenamed(key, "_from"), [split, "_p"]).drop("_p")
    donor = df.select(F.col(key).alias("_from"), *cols)
    keep = df.drop(*cols)
    return keep.join(pairs.select(key, "_from"), key).join(donor, "_from").drop("_from")
