"""Matched row pairs between contexts, in three tiers.

Tier 1 pairs equal sample ids, tier 2 the i-th rows of equal clusters, tier 3 nearest neighbours in
a scalar coordinate.  A context pair served by one tier is left alone by the later ones.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.functions.ordered import GROUP_LIMIT, largest_group, ordinal, running
from screenloom.functions.sizes import broadcast_if_small
from screenloom.session import durable

# Trust in a match by tier.
TIER_WEIGHTS = {1: 1.0, 2: 0.5, 3: 0.25}
COLS = ["ctx_a", "ctx_b", "row_a", "row_b", "weight", "tier"]


def big_enough(df: DataFrame, context: str, least: int = 2) -> DataFrame:
    """Rows of contexts with at least ``least`` rows."""
    ok = df.groupBy(context).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(ok, context, "left_semi")


def _tag(df: DataFrame, tier: int) -> DataFrame:
    return df.select(
        "ctx_a", "ctx_b", "row_a", "row_b", F.lit(TIER_WEIGHTS[tier]).alias("weight"), F.lit(tier).alias("tier")
    )


def _sides(df: DataFrame, context: str, row: str, *on: str):
    a = df.select(F.col(context).alias("ctx_a"), F.col(row).alias("row_a"), *on)
    b = df.select(F.col(context).alias("ctx_b"), F.col(row).alias("row_b"), *on)
    return a, b


def tier1(df: DataFrame, context: str, row: str, sample: str) -> DataFrame:
    """Equal ids across contexts, first row per (context, id).  After that reduction an id holds at
    most one row per context, so no id can flood the join."""
    first = df.groupBy(context, sample).agg(F.min(row).alias(row))
    a, b = _sides(first, context, row, sample)
    return _tag(a.join(b, sample).where(F.col("ctx_a") < F.col("ctx_b")), 1)


def covered(pairs: DataFrame) -> DataFrame:
    return pairs.select("ctx_a", "ctx_b").distinct()


def tier2(df: DataFrame, context: str, row: str, cluster: str, done: DataFrame, limit=GROUP_LIMIT) -> DataFrame:
    """The i-th row of a cluster in one context with the i-th in another, up to the shorter side."""
    pos = ordinal(df.select(context, row, cluster), [context, cluster], [row], "_i", limit).drop("_i_n")
    a, b = _sides(pos, context, row, cluster, "_i")
    hit = a.join(b, [cluster, "_i"]).where(F.col("ctx_a") < F.col("ctx_b"))
    return _tag(hit.join(done, ["ctx_a", "ctx_b"], "left_anti"), 2)


def context_pairs(df: DataFrame, context: str) -> DataFrame:
    """Every unordered pair of distinct context labels, from the sorted label list."""
    labels = df.select(context).distinct().agg(F.array_sort(F.collect_list(context)).alias("c"))
    a = labels.select("c", F.posexplode("c").alias("i", "ctx_a"))
    return a.select("ctx_a", F.explode(F.slice("c", F.col("i") + 2, F.greatest(F.size("c") - F.col("i") - 1, F.lit(0)))).alias("ctx_b"))


def tier3(df: DataFrame, context: str, row: str, u: str, done: DataFrame, k: int = 1, limit=GROUP_LIMIT) -> DataFrame:
    """For every row of the first context its k nearest rows of the second in coordinate ``u``, equal
    distances to the smaller row key.

    Distances are never taken between all rows: the distinct coordinates of the second context are
    numbered in order, a running count places every row of the first among them, and the k
    neighbours can only be at the k coordinates below and the k above, of each the k smallest keys."""
    if limit is not None:
        # a line holds the rows of two contexts
        limit = None if 2 * largest_group(df, [context]) <= limit else 0
    todo = context_pairs(df, context).join(done, ["ctx_a", "ctx_b"], "left_anti")
    rows = df.select(F.col(context).alias("_ctx"), F.col(row).alias("_row"), F.col(u).cast("double").alias("_u"))
    first = Window.partitionBy("_ctx", "_u").orderBy("_row")
    spots = rows.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= k)
    spots = spots.groupBy("_ctx", "_u").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    a = todo.join(rows.withColumnRenamed("_ctx", "ctx_a"), "ctx_a")
    b = todo.join(spots.withColumnRenamed("_ctx", "ctx_b"), "ctx_b")
    key = dict(df.dtypes)[row]
    # at equal u the coordinate of the second context comes first
    line = a.select("ctx_a", "ctx_b", "_row", "_u", F.lit(0).cast("bigint").alias("_b"), F.lit(None).cast(f"array<{key}>").alias("_rows")).unionByName(
        b.select("ctx_a", "ctx_b", F.lit(None).cast(key).alias("_row"), "_u", F.lit(1).cast("bigint").alias("_b"), "_rows"))
    line = line.withColumn("_side", 1 - F.col("_b"))
    placed = running(line, ["ctx_a", "ctx_b"], ["_u", "_side", "_row"], ["_b"], limit)
    mine = placed.where("_b = 0").select("ctx_a", "ctx_b", F.col("_row").alias("row_a"), F.col("_u").alias("_ua"),
                                        F.col("_b_before").alias("_at"), F.col("_b_total").alias("_nb"))
    theirs = placed.where("_b = 1").select("ctx_a", "ctx_b", "_rows", F.col("_u").alias("_ub"), F.col("_b_before").alias("_pos"))
    near = mine.select(
        "ctx_a", "ctx_b", "row_a", "_ua",
        F.explode(F.sequence(F.greatest(F.col("_at") - k, F.lit(0)), F.least(F.col("_at") + k - 1, F.col("_nb") - 1))).alias("_pos"),
    )
    hit = near.join(theirs, ["ctx_a", "ctx_b", "_pos"]).withColumn("row_b", F.explode("_rows"))
    w = Window.partitionBy("ctx_a", "ctx_b", "row_a").orderBy(F.abs(F.col("_ua") - F.col("_ub")), "row_b")
    return _tag(hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k), 3)


def cascade(
    df: DataFrame, context: str, row: str, sample: str | None = None, cluster: str | None = None, u: str | None = None,
    k: int = 1, limit=GROUP_LIMIT,
) -> DataFrame:
    """All tiers in order; a tier without its column is skipped.  The columns in use are written once,
    and so is every tier: what later tiers and the caller read is never joined again."""
    named = [c for c in (context, row, sample, cluster, u) if c]
    df = big_enough(durable(df.select(*dict.fromkeys(named))), context)
    empty = df.sparkSession.createDataFrame([], df.select(
        F.col(context).alias("ctx_a"), F.col(context).alias("ctx_b")).schema)
    parts, done = [], empty
    if sample:
        t = durable(tier1(df, context, row, sample))
        parts.append(t)
        done = durable(covered(t))
    if cluster:
        t = durable(tier2(df, context, row, cluster, done, limit))
        parts.append(t)
        done = durable(done.unionByName(covered(t)))
    if u:
        parts.append(durable(tier3(df, context, row, u, done, k, limit)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tier_counts(pairs: DataFrame) -> DataFrame:
    """Context pairs served and row pairs made by each tier, zeros included."""
    made = pairs.groupBy("tier", "ctx_a", "ctx_b").agg(F.count(F.lit(1)).alias("n"))
    per = made.groupBy("tier").agg(F.count(F.lit(1)).alias("n_ctx_pairs"), F.sum("n").alias("n_row_pairs"))
    tiers = pairs.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("tier"))
    return tiers.join(per, "tier", "left").na.fill(0)


def matched_values(pairs: DataFrame, df: DataFrame, row: str, value: str) -> DataFrame:
    v = df.select(F.col(row).alias("_row"), F.col(value).alias("_v"))
    return (
        pairs.join(v.select(F.col("_row").alias("row_a"), F.col("_v").alias("a")), "row_a")
        .join(v.select(F.col("_row").alias("row_b"), F.col("_v").alias("b")), "row_b")
    )


def rank_consistency(values: DataFrame, limit=GROUP_LIMIT, bound: int | None = None) -> DataFrame:
    """Weighted mean rank correlation over context pairs, per tier and combined (tier 0).
    Undefined pairs carry no weight.  ``bound`` states the most row pairs a context pair can have."""
    from screenloom.functions.ordered import average_rank
    from screenloom.functions.stats import pearson

    keys = ["ctx_a", "ctx_b", "tier", "weight"]
    if bound is not None and limit is not None:
        limit = None if bound <= limit else 0
    values = values.select(*keys, "a", "b")
    if limit == 0:
        # each ranked column and the join of both read the pairs
        values = durable(values)
    ranked = average_rank(values, keys, {"_ra": "a", "_rb": "b"}, limit)
    per = ranked.groupBy(*keys).agg(pearson("_ra", "_rb").alias("rho"))
    sets = per.groupingSets([["tier"], []], "tier")
    return sets.agg(
        F.try_divide(F.sum(F.col("weight") * F.col("rho")), F.sum(F.when(F.col("rho").isNotNull(), F.col("weight")))).alias("rho"),
        F.count(F.lit(1)).alias("n_ctx_pairs"),
    ).select(F.coalesce("tier", F.lit(0)).alias("tier"), "rho", "n_ctx_pairs")


#: Rows that a task puts in order against each other.
ORDERED_IN_TASK = 500_000


def _spans(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place, and first place behind, of the run that each row is in; ``new`` marks where runs begin."""
    at, run = np.flatnonzero(new), np.cumsum(new) - 1
    return at[run], np.r_[at[1:], len(new)][run]


def ordered_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs among points (x, y) of which each stands for n rows; x counts from 0, ties are left out.

    Two points part at exactly one bit of x.  From the highest bit down, points lie by the bits above and then by y, so
    running counts give the partners of every point that has the bit."""
    at = np.argsort(y, kind="stable")
    x, y, n = x[at], y[at], n[at]
    conc = disc = 0
    for bit in reversed(range(int(x.max(initial=0)).bit_length())):
        above, high = x >> (bit + 1), (x >> bit & 1).astype(bool)
        new = np.r_[True, above[1:] != above[:-1]]
        lo, hi = _spans(new)
        tie_lo, tie_hi = _spans(new | np.r_[True, y[1:] != y[:-1]])
        low = np.r_[0, np.cumsum(np.where(high, 0, n))]
        conc += int((n * (low[tie_lo] - low[lo]))[high].sum())
        disc += int((n * (low[hi] - low[tie_hi]))[high].sum())
        # points without the bit first, in the order they have
        lows = np.r_[0, np.cumsum(~high)]
        before = lows[:-1] - lows[lo]
        to = np.where(high, lo + (lows[hi] - lows[lo]) + (np.arange(len(x)) - lo - before), lo + before)
        at = np.empty_like(to)
        at[to] = np.arange(len(x))
        x, y, n = x[at], y[at], n[at]
    return conc, disc


def _order_task(keys: list[str]):
    """Grouped Arrow task over a strip of one column: its ordered pairs.  In a strip of b, rows of one strip of a are ties."""

    def run(table):
        import pyarrow as pa

        x, y = (np.unique(table[c].to_numpy(), return_inverse=True)[1] for c in ("_a" if table["_side"][0].as_py() == 0 else "_i", "_b"))
        conc, disc = ordered_pairs(x.astype(np.int64), y, table["_n"].to_numpy())
        return pa.table({k: table[k].slice(0, 1) for k in keys} | {"conc": pa.array([conc], pa.int64()), "disc": pa.array([disc], pa.int64())})

    return run


def _strip(cuts: Column, value: Column) -> Column:
    """Number of the value's strip, in order: even for a value that is a cut, which has a strip to itself, else odd."""
    at = F.size(F.filter(cuts, lambda c: c <= value))
    return 2 * at + F.when((at > 0) & (F.get(cuts, at - 1) == value), 0).otherwise(1)


def _strip_pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, conc, disc: ordered pairs of rows in different strips of both columns, from the rows per pair of strips."""
    join = lambda x, y, on: x.join(y, on, "left" if len(on) > len(keys) else "inner") if on else x.crossJoin(y)
    grid = join(cells.select(*keys, "_i").distinct(), cells.select(*keys, "_j").distinct(), keys)
    grid = join(grid, cells, [*keys, "_i", "_j"]).na.fill(0, ["_n"])
    row, line = Window.partitionBy(*keys, "_i"), Window.partitionBy(*keys, "_j").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_left", F.sum("_n").over(row.orderBy("_j").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_left"])
    grid = grid.withColumn("_right", F.sum("_n").over(row) - F.col("_left") - F.col("_n"))
    sums = [(F.col("_n") * F.coalesce(F.sum(c).over(line), F.lit(0))).alias(name) for c, name in (("_left", "conc"), ("_right", "disc"))]
    return grid.select(*keys, *sums)


def order_agreement(df: DataFrame, keys: list[str], a: str, b: str, limit=GROUP_LIMIT) -> DataFrame:
    """Share of row pairs ordered alike by both columns, ties in either left out; a null is in no pair.

    Pairs are counted, never made, and equal rows travel as one.  Beyond ``ORDERED_IN_TASK`` rows of a group (``limit``, if
    smaller; 0 always) both numeric columns are cut into strips.  Two rows lie in one strip of a, or in one strip of b but not of a, which
    are tasks of one strip's rows; or in different strips of both, which the table of rows per pair of strips counts.  So a row
    travels twice whatever the number of rows.  Cuts are approximate quantiles: they set the tasks' sizes, not the result."""
    known = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (*keys, a, b)])
    rows = durable(df.where(known).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    most, groups = per.agg(F.coalesce(F.max("_k"), F.lit(0)), F.count(F.lit(1))).first()
    size = ORDERED_IN_TASK if limit is None else min(limit, ORDERED_IN_TASK)
    strips = max(2, -(-most // ORDERED_IN_TASK)) if most > size else 1
    if strips == 1:
        placed = rows.withColumns({"_i": F.lit(1), "_j": F.lit(0)})
    else:
        at = [i / strips for i in range(1, strips)]
        cuts = [F.array_sort(F.array_distinct(F.percentile_approx(c, at, max(10_000, 20 * strips)))).alias(f"_cut{c}") for c in ("_a", "_b")]
        cuts = broadcast_if_small(rows.groupBy(*keys).agg(*cuts))
        placed = rows.join(cuts, keys) if keys else rows.crossJoin(cuts)
        placed = placed.select(*rows.columns, _strip(F.col("_cut_a"), F.col("_a")).alias("_i"), _strip(F.col("_cut_b"), F.col("_b")).alias("_j"))
    # a strip of one value has no pairs
    ends = F.array(*[F.struct(F.lit(s).alias("_side"), F.col(c).alias("_strip")) for s, c in enumerate(("_i", "_j"))])
    tasks = placed.select("*", F.inline(F.filter(ends, lambda e: e["_strip"] % 2 == 1)))
    # few groups that cost much: not put together by size
    tasks = tasks.repartition(max(1, min(4 * groups * strips, 4000)), *keys, "_side", "_strip").groupBy(*keys, "_side", "_strip")
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["conc bigint", "disc bigint"])
    made = tasks.applyInArrow(_order_task(keys), schema)
    if strips > 1:
        made = made.unionByName(_strip_pairs(placed.groupBy(*keys, "_i", "_j").agg(F.sum("_n").alias("_n")), keys))
    return made.groupBy(*keys).agg(F.sum("conc").alias("n_concordant"), F.sum("disc").alias("n_discordant")).withColumn(
        "agreement", F.try_divide(F.col("n_concordant"), F.col("n_concordant") + F.col("n_discordant"))
    )
