"""Evaluation metrics over score tables, as grouped aggregates."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.functions import stats as S
from screenloom.functions.ordered import GROUP_LIMIT, average_rank, ordinal, path, running


def spearman(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], limit=GROUP_LIMIT, bound=None) -> DataFrame:
    """Rank correlation per group; ``pairs`` maps an output name to its two columns.  Each column
    is ranked once however many pairs it is in."""
    cols = sorted({c for p in pairs.values() for c in p})
    ranked = average_rank(df, keys, {f"_r_{c}": c for c in cols}, limit, bound)
    aggs = [S.pearson(f"_r_{a}", f"_r_{b}").alias(name) for name, (a, b) in pairs.items()]
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def top_k_size(k, n: Column) -> Column:
    """A fraction of n rounded half to even, at least 1; or a count, at most n."""
    if isinstance(k, float) and 0 < k <= 1:
        return F.greatest(F.lit(1), F.bround(F.lit(k) * n).cast("bigint"))
    return F.least(F.lit(int(k)).cast("bigint"), n)


def ndcg(df: DataFrame, keys: list[str], y: str, yhat: str, row_key: str, k: int | float = 0.1, limit=GROUP_LIMIT) -> DataFrame:
    """Discounted gain of the top k by prediction over that of the best order; ties by row key.
    Gains are shifted when the smallest is negative; NULL when the best order gains nothing."""
    limit = path(df, keys, limit)
    base = df.select(*keys, F.col(row_key).alias("_k"), F.col(y).alias("_y"), (-F.col(yhat)).alias("_p"), (-F.col(y)).alias("_q"))
    ranked = ordinal(base, keys, ["_p", "_k"], "_i", limit)
    ranked = ordinal(ranked.drop("_i_n"), keys, ["_q", "_k"], "_j", limit)
    low = base.groupBy(*keys).agg(F.min("_y").alias("_lo")) if keys else base.agg(F.min("_y").alias("_lo"))
    ranked = ranked.join(low, keys) if keys else ranked.withColumn("_lo", low.scalar())
    n = F.col("_j_n")
    size = top_k_size(k, n)
    gain = F.col("_y") + F.greatest(F.lit(0.0), -F.col("_lo"))
    dcg = F.sum(F.when(F.col("_i") < size, gain / F.log2(F.col("_i") + 2)))
    best = F.sum(F.when(F.col("_j") < size, gain / F.log2(F.col("_j") + 2)))
    out = F.try_divide(dcg, best).alias("ndcg")
    return ranked.groupBy(*keys).agg(out) if keys else ranked.agg(out)


def predictive_bundle(df: DataFrame, keys: list[str], y: str, yhat: str, row_key: str, k: int | float = 0.1, limit=GROUP_LIMIT) -> DataFrame:
    limit = path(df, keys, limit)
    ranked = average_rank(df, keys, {"_ry": y, "_rp": yhat}, limit)
    main = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), S.r2(y, yhat).alias("r2"), S.pearson(y, yhat).alias("pearson"),
        S.pearson("_ry", "_rp").alias("spearman"),
    )
    return main.join(ndcg(df, keys, y, yhat, row_key, k, limit), keys)


def seed_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_seeds")
    )


def partial_rank_correlation(df: DataFrame, keys: list[str], features: list[str], y: str, control: str, limit=GROUP_LIMIT, bound=None) -> DataFrame:
    """Rank correlation of each feature with y, pooled and given the control; one row per feature."""
    ranked = average_rank(df, keys, {f"_r_{c}": c for c in [*features, y, control]}, limit, bound)
    aggs = [S.pearson(f"_r_{y}", f"_r_{control}").alias("r_yz")]
    for f in features:
        aggs += [S.pearson(f"_r_{f}", f"_r_{y}").alias(f"xy_{f}"), S.pearson(f"_r_{f}", f"_r_{control}").alias(f"xz_{f}")]
    wide = ranked.groupBy(*keys).agg(*aggs)
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f"xy_{f}").alias("r_xy"), F.col(f"xz_{f}").alias("r_xz")) for f in features]
    long = wide.select(*keys, "r_yz", F.explode(F.array(*parts)).alias("p")).select(*keys, "r_yz", "p.*")
    return long.select(
        *keys, "feature", F.col("r_xy").alias("pooled"), F.col("r_xz").alias("with_control"),
        S.partial_corr("r_xy", "r_xz", "r_yz").alias("partial"),
    )


def selection_table(val: DataFrame, arm: str, option: str, mean: str, sd: str) -> DataFrame:
    """Best and second option per arm on a finite validation mean, the margin, and whether the
    margin lies inside the seed SD.  Undefined means are never ranked."""
    finite = val.where(F.col(mean).isNotNull() & ~F.isnan(mean) & (F.abs(mean) < float("inf")))
    w = Window.partitionBy(arm).orderBy(F.desc(mean), option)
    top = finite.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    return top.groupBy(arm).agg(
        F.max(F.when(F.col("rn") == 1, F.col(option))).alias("selected"),
        F.max(F.when(F.col("rn") == 2, F.col(option))).alias("runner_up"),
        F.max(F.when(F.col("rn") == 1, F.col(mean))).alias("best"),
        F.max(F.when(F.col("rn") == 2, F.col(mean))).alias("second"),
        F.max(F.when(F.col("rn") == 1, F.col(sd))).alias("seed_sd"),
    ).select(
        arm, "selected", "runner_up", (F.col("best") - F.col("second")).alias("margin"),
        F.col("best").alias("best_val_mean"), "seed_sd",
        (F.col("best") - F.col("second") < F.col("seed_sd")).alias("margin_inside_seed_sd"),
    )


def select_alpha(grid: DataFrame, keys: list[str], alpha="alpha", score="r2") -> DataFrame:
    """Largest finite score; an exact tie goes to the largest alpha; no finite score is degenerate."""
    v = F.col(score)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    best = grid.groupBy(*keys).agg(
        F.max(F.when(ok, F.struct(v.alias("s"), F.col(alpha).alias("a")))).alias("b"),
        F.count_if(ok).alias("n_finite"),
    )
    ties = grid.where(ok).join(best.select(*keys, F.col("b.s").alias("_s")), keys).where(v == F.col("_s"))
    ties = ties.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tied"))
    return best.join(ties, keys, "left").select(
        *keys, F.col("b.a").alias("selected_alpha"), F.col("b.s").alias("selected_r2"), "n_finite",
        (F.coalesce("n_tied", F.lit(0)) > 1).alias("tie_applied"),
        F.when(F.col("n_finite") > 0, "OK").otherwise("PROBE_DEGENERATE").alias("status"),
    )


def ecdf(df: DataFrame, value: str, is_train: Column, limit=GROUP_LIMIT) -> DataFrame:
    """Share of training rows at or below each value, held to [1/n, 1].  Counting runs over
    distinct values, then joins back."""
    at = df.groupBy(F.col(value).alias("_v")).agg(F.count_if(is_train).alias("_t"))
    at = running(at, [], ["_v"], ["_t"], limit)
    n = F.col("_t_total").cast("double")
    rank = F.greatest(F.try_divide(F.lit(1.0), n), F.least(F.lit(1.0), (F.col("_t_before") + F.col("_t")) / n))
    return df.join(at.select("_v", rank.alias("ecdf")), F.col(value) == F.col("_v")).drop("_v")


def rank_tail_weight(ecdf_col="ecdf", gamma=1.0) -> Column:
    return F.lit(1.0) + F.lit(float(gamma)) * F.abs(F.col(ecdf_col) - 0.5)


def quintile_tail_weight(bin_col: Column, weights=(2.0, 1.0, 1.0, 1.0, 2.0)) -> Column:
    return F.get(F.array(*[F.lit(float(w)) for w in weights]), bin_col)


def density_weights(train: DataFrame, value: str, bins=20, sigma=2.0, cap=5.0, tiny=1e-12) -> DataFrame:
    """bin, left edge, right edge, count, weight from smoothed label density of training rows.

    Counts per equal-width left-closed bin are smoothed by a Gaussian cut at four sigma with mirrored
    ends; the weight is the inverse root density, scaled to mean one over training rows, then cut."""
    ends = train.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    step = (hi - lo) / F.lit(float(bins))
    # ends are columns first: a subquery may not stand inside a higher-order function
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("_lo") + i * F.col("_step"))
    index = F.size(F.filter(inner, lambda e: F.col(value) >= e))
    spark = train.sparkSession
    found = train.select(value, lo.alias("_lo"), step.alias("_step")).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    table = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left")
    table = table.select("bin", F.coalesce("c", F.lit(0.0)).alias("c"))
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    kernel = {j: w / sum(raw) for j, w in zip(range(-radius, radius + 1), raw)}
    # every bin hands its count to each bin its mirrored neighbourhood reaches
    def mirror(i):
        p = i % (2 * bins)
        return p if p < bins else 2 * bins - 1 - p

    flow: dict[tuple[int, int], float] = {}
    for i in range(bins):
        for j, w in kernel.items():
            flow[(i, mirror(i + j))] = flow.get((i, mirror(i + j)), 0.0) + w
    weights = spark.createDataFrame([(i, s, w) for (i, s), w in flow.items()], "to int, bin int, w double")
    smooth = weights.join(table, "bin").groupBy(F.col("to").alias("bin")).agg(F.sum(F.col("w") * F.col("c")).alias("s"))
    total = smooth.agg(F.greatest(F.sum("s"), F.lit(tiny)).alias("t")).scalar()
    dens = smooth.join(table, "bin").select("bin", "c", (F.lit(1.0) / F.sqrt(F.col("s") / total + tiny)).alias("w"))
    mean = dens.agg((F.sum(F.col("w") * F.col("c")) / F.sum("c")).alias("m")).scalar()
    return dens.select(
        "bin", (lo + F.col("bin") * step).alias("left_edge"), (lo + (F.col("bin") + 1) * step).alias("right_edge"),
        F.col("c").alias("n_train"), F.least(F.lit(cap), F.col("w") / mean).alias("weight"),
    )


def density_weighted_error(rows: DataFrame, table: DataFrame, y: str, yhat: str) -> DataFrame:
    """Mean squared error of scored rows, each weighted by its label's bin: bins are open on the left, and
    labels outside the edges belong to the first or last.  A zero weight total gives the plain mean."""
    bins = table.agg(F.array_sort(F.collect_list(F.struct("bin", "left_edge", "weight"))).alias("b")).select("b").scalar()
    # the table is a column first: a subquery may not stand inside a higher-order function
    marked = rows.select(F.col(y).alias("_y"), F.col(yhat).alias("_p"), bins.alias("_b"))
    inner = F.filter(F.slice("_b", F.lit(2), F.size("_b")), lambda b: F.col("_y") > b["left_edge"])
    weighted = marked.withColumn("_w", F.get("_b", F.size(inner))["weight"])
    return weighted.agg(S.weighted_mse("_y", "_p", "_w").alias("weighted_mse"), F.count(F.lit(1)).alias("n"))


def transfer_gap(per_context: DataFrame, home: Column, r2="r2", rho="spearman") -> DataFrame:
    """Home metric minus away metric for every away context, relative gap, and the worst context."""
    at_home = per_context.where(home).agg(F.avg(r2).alias("h"), F.avg(rho).alias("s"))
    h, s = at_home.select("h").scalar(), at_home.select("s").scalar()
    away = per_context.where(~home)
    worst = per_context.agg(F.min(r2).alias("w")).scalar()
    return away.select(
        "*", (h - F.col(r2)).alias("gap"), F.try_divide(h - F.col(r2), F.abs(h)).alias("gap_rel"),
        (s - F.col(rho)).alias("spearman_gap"), worst.alias("robustness_worst_ctx"),
    )
