"""Checks that return one row each: check_name, n_bad, pass."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from screenloom.functions.ordered import GROUP_LIMIT, ordinal
from screenloom.operators.features import quantiles_by_rank
from screenloom.session import durable


class Forbidden(ValueError):
    """A column, split or artefact that must not be read."""


def guard_columns(wanted: list[str], deny: list[str] = (), allow: list[str] | None = None) -> list[str]:
    """The columns to read, checked before any read."""
    bad = [c for c in wanted if c in deny or (allow is not None and c not in allow)]
    if bad:
        raise Forbidden(f"columns not to be read: {bad}")
    return list(wanted)


def guard_splits(wanted: list[str], allowed: list[str]) -> list[str]:
    bad = [s for s in wanted if s not in allowed]
    if bad:
        raise Forbidden(f"splits not to be read: {bad}")
    return list(wanted)


def check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """Rows for which ``bad`` holds."""
    n = F.count_if(bad)
    return df.agg(n.alias("n_bad")).select(
        F.lit(name).alias("check_name"), "n_bad", (F.col("n_bad") == 0).alias("pass")
    )


def schema_matches(df: DataFrame, expected: str) -> list[str]:
    """Columns whose type differs from the DDL text, as messages; empty when all agree."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    want: StructType = _parse_datatype_string(expected)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [
        f"{f.name}: {have.get(f.name)} is not {f.dataType.simpleString()}"
        for f in want if have.get(f.name) != f.dataType.simpleString()
    ]


def vector_width(df: DataFrame, col: str, width: int, name="vector_width") -> DataFrame:
    return check(df, name, F.col(col).isNull() | (F.size(col) != width))


def unique_keys(df: DataFrame, keys: list[str], name="unique_keys") -> DataFrame:
    """Surplus rows over distinct keys; counting per key combines before the shuffle."""
    per = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("n_bad")).select(
        F.lit(name).alias("check_name"), "n_bad", (F.col("n_bad") == 0).alias("pass")
    )


def key_sets(left: DataFrame, right: DataFrame, keys: list[str], name="key_sets") -> DataFrame:
    """Keys on one side only, from one pass over both sides."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(
        F.count_if(F.col("r") == 0).alias("left_only"),
        F.count_if(F.col("l") == 0).alias("right_only"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched"),
    ).select(
        F.lit(name).alias("check_name"), "left_only", "right_only", "matched",
        (F.col("left_only") + F.col("right_only")).alias("n_bad"),
        (F.col("left_only") + F.col("right_only") == 0).alias("pass"),
    )


def values_ok(df: DataFrame, col: str, name="values", non_negative=True) -> DataFrame:
    v = F.col(col)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return check(df, name, bad | (v < 0) if non_negative else bad)


def cast_collisions(df: DataFrame, typed: str, kind: str, name="cast_collisions") -> DataFrame:
    """Ids that become equal as text although their stored kind differs."""
    per = df.groupBy(F.trim(F.col(typed).cast("string")).alias("t")).agg(F.countDistinct(kind).alias("kinds"))
    return check(per, name, F.col("kinds") > 1)


def covers_once(units: DataFrame, whole: DataFrame, key: str, name="covers_once") -> DataFrame:
    """Keys that the units hold other than exactly once."""
    both = units.select(key, F.lit(1).alias("u"), F.lit(0).alias("w")).unionByName(
        whole.select(key, F.lit(0).alias("u"), F.lit(1).alias("w"))
    )
    per = both.groupBy(key).agg(F.sum("u").alias("u"), F.max("w").alias("w"))
    return check(per, name, (F.col("u") != 1) | (F.col("w") != 1))


def path_equality(a: DataFrame, b: DataFrame, keys: list[str], value: str, exact=1e-10, equivalent=1e-8) -> DataFrame:
    """Compare two computations of one long table: differences and a graded verdict."""
    j = a.select(*keys, F.col(value).alias("va")).join(
        b.select(*keys, F.col(value).alias("vb")), keys, "full_outer"
    )
    diff = F.abs(F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0)))
    j = durable(j.select(diff.alias("diff"), (F.col("va").isNull() | F.col("vb").isNull()).alias("lone")))
    agg = j.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("lone").alias("n_unpaired"),
        F.max("diff").alias("max_diff"),
        F.avg("diff").alias("mean_diff"),
        F.count_if(F.col("diff") > exact).alias("n_over_exact"),
        F.count_if(F.col("diff") > equivalent).alias("n_over_equivalent"),
    )
    agg = agg.withColumn("q", quantiles_by_rank(j, "diff", [0.5, 0.95, 0.99], []).scalar())
    verdict = (
        F.when(F.col("max_diff") <= exact, "EXACT")
        .when(F.col("max_diff") <= equivalent, "NUMERICALLY_EQUIVALENT")
        .otherwise("MISMATCH")
    )
    return agg.select(
        "n", "n_unpaired", "max_diff", "mean_diff", F.col("q")[0].alias("median_diff"),
        F.col("q")[1].alias("p95_diff"), F.col("q")[2].alias("p99_diff"),
        "n_over_exact", "n_over_equivalent", verdict.alias("verdict"),
    )


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], count: str, name="reconcile") -> DataFrame:
    """Groups whose counts differ between two paths, absent ones included."""
    j = a.select(*keys, F.col(count).alias("a")).join(b.select(*keys, F.col(count).alias("b")), keys, "full_outer")
    return check(j, name, ~F.col("a").eqNullSafe(F.col("b")))


def digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free content digest: row count, sum and xor of 64-bit hashes of the typed values."""
    h = F.xxhash64(*[F.col(c) for c in cols])
    wide = F.sum(h.cast("decimal(38,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("n"), wide.cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor")
    )


#: Rows of a table, and digests of the level below, under one digest.
DIGEST_ROWS = 4096
EXACT = (T.IntegralType, T.DecimalType, T.StringType, T.BooleanType, T.DateType)


def row_digest(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 of a row's values, each with its type and the length of its text, so that neither types nor borders blur.

    Columns whose text form differs between engines (floats, timestamps, nested ones) are refused: cast them first."""
    parts = []
    for c in cols:
        kind = df.schema[c].dataType
        if not isinstance(kind, EXACT):
            raise ValueError(f"{c}: cast {kind.simpleString()} to an exact type")
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.lit(kind.simpleString() + ":"), F.length(text).cast("string"), F.lit(":"), text), F.lit(kind.simpleString() + ":-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def ordered_digest(df: DataFrame, order: list[str], cols: list[str], slice_rows: int = DIGEST_ROWS, limit=GROUP_LIMIT) -> DataFrame:
    """n, digest: of the typed values of all rows in the order of ``order`` (nulls first), rows equal there by their own digest.

    A tree of digests: of every row, of each run of ``slice_rows`` rows in order, of each run of those, until one is left (two
    levels at least).  So the result does not depend on files or partitions, changes with any value, type or place,
    and no task holds more than a run.  An empty table has the digest of the empty text."""
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], row_digest(df, cols).alias("h"))
    level = ordinal(rows.withColumn("_t", F.monotonically_increasing_id()), [], [*[f"_o{i}" for i in range(len(order))], "h", "_t"], "i", limit).select("i", "h")
    n = df.count()
    left, depth = n, 0
    while left > 1 or depth < 2:
        run = F.floor(F.col("i") / slice_rows)
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        level = level.groupBy(run.alias("i")).agg(F.sha2(F.array_join(in_order, ""), 256).alias("h"))
        left, depth = -(-left // slice_rows), depth + 1
    return level.agg(F.lit(n).cast("bigint").alias("n"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def portable_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free digest that any engine with MD5 can repeat; for columns whose text form is the same
    everywhere (integers, strings)."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")
    return df.select(word.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor")
    )


def repeats_agree(df: DataFrame, keys: list[str], value: str, name="repeats_agree") -> DataFrame:
    per = df.groupBy(*keys).agg(F.count_distinct(value).alias("k"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))
    return check(per, name, (F.col("k") > 1) | ((F.col("nulls") > 0) & (F.col("nulls") < F.col("n"))))


def same_multiset(a: DataFrame, b: DataFrame, cols: list[str], name="same_multiset") -> DataFrame:
    """Values whose multiplicities differ; one signed count per value."""
    both = a.select(*cols, F.lit(1).alias("s")).unionByName(b.select(*cols, F.lit(-1).alias("s")))
    return check(both.groupBy(*cols).agg(F.sum("s").alias("s")), name, F.col("s") != 0)


def all_checks(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select("check_name", "n_bad", "pass") for p in parts])
