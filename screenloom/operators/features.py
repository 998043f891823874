"""Feature statistics, selection, remapping and train-only scaling."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from screenloom.functions.stats import pooled_m2
from screenloom.functions.vector import repair


def gene_stats(values: DataFrame, groups: DataFrame, value="mean") -> DataFrame:
    """gene_idx, n, mean, var, lo, hi over all rows of ``groups``; absent values count as zero.

    Zeros enter through the group count, so the groups x genes grid is never built.
    """
    n = groups.agg(F.count(F.lit(1)).alias("n"))
    present = values.groupBy("gene_idx").agg(
        F.count(F.lit(1)).alias("k"),
        F.avg(value).alias("m"),
        F.var_pop(value).alias("s"),
        F.min(value).alias("a"),
        F.max(value).alias("b"),
    )
    total = n.scalar()
    full = F.col("k") == total
    return present.select(
        "gene_idx",
        total.alias("n"),
        (F.col("m") * F.col("k") / total).alias("mean"),
        (pooled_m2(F.col("k"), F.col("m"), F.col("s"), total) / total).alias("var"),
        F.when(full, F.col("a")).otherwise(F.least("a", F.lit(0.0))).alias("lo"),
        F.when(full, F.col("b")).otherwise(F.greatest("b", F.lit(0.0))).alias("hi"),
    )


def top_genes(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best genes, ties to the smaller index.  Sort-and-limit keeps k rows per task and
    merges, so no global window is needed."""
    return scored.orderBy(F.desc(score), "gene_idx").limit(k)


def cross_context_ratio(values: DataFrame, groups: DataFrame, context="batch", eps=1e-6, value="mean") -> DataFrame:
    """Within-context variance over between-context variance of means, per gene.

    Contexts without the gene contribute a zero mean and variance through the context counts.
    """
    per = groups.groupBy(context).agg(F.count(F.lit(1)).alias("n"))
    totals = per.agg(
        F.count(F.lit(1)).alias("n_ctx"), F.count_if(F.col("n") >= 2).alias("n_var")
    )
    cells = (
        values.groupBy(context, "gene_idx")
        .agg(F.count(F.lit(1)).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("s"))
        .join(per, context)
        .select(
            "gene_idx",
            (F.col("m") * F.col("k") / F.col("n")).alias("mu"),
            F.when(F.col("n") >= 2, pooled_m2(F.col("k"), F.col("m"), F.col("s"), F.col("n")) / F.col("n")).alias("w"),
        )
    )
    n_ctx, n_var = totals.select("n_ctx").scalar(), totals.select("n_var").scalar()
    per_gene = cells.groupBy("gene_idx").agg(
        F.count(F.lit(1)).alias("k"), F.avg("mu").alias("m"), F.var_pop("mu").alias("s"), F.sum("w").alias("w")
    )
    within = F.try_divide(F.coalesce(F.col("w"), F.lit(0.0)), n_var)
    between = pooled_m2(F.col("k"), F.col("m"), F.col("s"), n_ctx) / n_ctx
    return per_gene.select(
        "gene_idx",
        within.alias("within"),
        between.alias("between"),
        F.when(n_ctx >= 2, within / (between + F.lit(eps))).alias("score"),
    )


#: Names of a wanted list in one row.
PIECE = 10_000


def remap(values: DataFrame, groups: DataFrame, genes: DataFrame, wanted: DataFrame, keys: list[str], value="delta") -> DataFrame:
    """Values on the wanted symbol list: first native gene per symbol, zero when unmapped, then
    repair and clip.  ``genes`` is (gene_idx, symbol), ``wanted`` is (pos, symbol).

    The result is groups x wanted rows by definition; the list travels in pieces of ``PIECE`` names, so
    it can have any length."""
    first = genes.groupBy("symbol").agg(F.min("gene_idx").alias("gene_idx"))
    piece = F.floor(F.col("pos") / PIECE).cast("bigint").alias("_piece")
    mapping = wanted.join(first, "symbol", "left").groupBy(piece).agg(
        F.collect_list(F.struct("pos", "symbol", "gene_idx")).alias("m")
    )
    pieces = mapping.agg(F.max("_piece")).scalar()
    spread = groups.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)).alias("_piece"))
    grid = spread.join(mapping, "_piece").select(*keys, F.explode("m").alias("m")).select(*keys, "m.*")
    return grid.join(values, [*keys, "gene_idx"], "left").select(
        *keys, "pos", "symbol",
        F.col("gene_idx").isNotNull().alias("mapped"),
        repair(F.coalesce(F.col(value), F.lit(0.0))).alias(value),
    )


def assemble(values: DataFrame, groups: DataFrame, chosen: DataFrame, keys: list[str], value: str, name: str = "profile") -> DataFrame:
    """One row per group with its values on the chosen genes as a vector, absent ones zero.

    ``chosen`` is (gene_idx, pos); positions run from 0.  The list travels in pieces of ``PIECE`` genes."""
    piece = F.floor(F.col("pos") / PIECE).cast("bigint").alias("_piece")
    packed = chosen.groupBy(piece).agg(F.collect_list(F.struct("pos", "gene_idx")).alias("m"))
    pieces = packed.agg(F.max("_piece")).scalar()
    spread = groups.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)).alias("_piece"))
    grid = spread.join(packed, "_piece").select(*keys, F.explode("m").alias("m")).select(*keys, "m.*")
    filled = grid.join(values.select(*keys, "gene_idx", F.col(value).alias("_v")), [*keys, "gene_idx"], "left")
    rows = filled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_v", F.lit(0.0)).alias("v")))).alias("_m"))
    return rows.select(*keys, F.transform("_m", lambda x: x["v"]).alias(name))


def positions(chosen: DataFrame) -> DataFrame:
    """gene_idx, pos: chosen genes numbered from 0 in the order of their index."""
    from screenloom.functions.ordered import ordinal

    return ordinal(chosen.select("gene_idx"), [], ["gene_idx"], "pos").select("gene_idx", F.col("pos").cast("int").alias("pos"))


def fit_scaler(df: DataFrame, features: list[str], split="split", train="train", tiny=1e-12) -> DataFrame:
    """feature, mean, scale, var, n, near_constant from the training rows only.

    One wide aggregate over the rows, unpivoted afterwards: the rows are not multiplied."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.var_pop(f).alias(f"{f}__var"), F.count(f).alias(f"{f}__n")]
    wide = df.where(F.col(split) == train).agg(*aggs)
    parts = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"),
            F.col(f"{f}__var").alias("var"), F.col(f"{f}__n").alias("n"),
        )
        for f in features
    ]
    return (
        wide.select(F.explode(F.array(*parts)).alias("p"))
        .select("p.*")
        .select(
            "feature", "mean",
            F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0).alias("scale"),
            "var", "n", (F.col("var") <= tiny).alias("near_constant"),
        )
    )


def apply_scaler(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Scale every split with stored statistics.  There is no way to fit from here.

    The statistics are one row per named feature, read once as scalar subqueries."""
    one = stats.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("s")
    ).select("s").scalar()
    out = df.withColumn("_s", one)
    for f in features:
        out = out.withColumn(f, (F.col(f) - F.col("_s")[f]["mean"]) / F.col("_s")[f]["scale"])
    return out.drop("_s")


def fit_block_scaler(df: DataFrame, vec: str, split="split", train="train", tiny=1e-12) -> DataFrame:
    """pos, mean, scale, var, n, near_constant of every coordinate of a vector, from the training rows
    only; one row of sums per task, whatever the width."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    m = df.where(F.col(split) == train).agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("m"))
    m = m.select(vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"), F.col("m.count").alias("n"))
    long = m.select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("pos", "z"))
    # the summary divides by n - 1
    var = F.col("z.var") * (F.col("n") - 1) / F.col("n")
    return long.select(
        "pos", F.col("z.mean").alias("mean"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("scale"),
        var.alias("var"), "n", (var <= tiny).alias("near_constant"),
    )


def apply_block_scaler(df: DataFrame, stats: DataFrame, vec: str, name: str | None = None) -> DataFrame:
    """Scale a vector of every split with stored statistics.  There is no way to fit from here."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "scale"))).alias("s")).select("s").scalar()
    # the subquery is a column first: it may not stand inside a higher-order function
    out = df.withColumn("_s", one)
    scaled = F.zip_with(F.col(vec).cast("array<double>"), "_s", lambda x, s: (x - s["mean"]) / s["scale"])
    return out.withColumn(name or vec, scaled).drop("_s")


def support(df: DataFrame, features: list[str], split="split", train="train") -> Column:
    aggs = []
    for f in features:
        aggs += [F.min(f).alias(f"{f}__lo"), F.max(f).alias(f"{f}__hi")]
    wide = df.where(F.col(split) == train).agg(*aggs)
    return wide.select(F.struct(*wide.columns).alias("s")).scalar()


def out_of_range(df: DataFrame, features: list[str], split="split", train="train") -> DataFrame:
    """Rows per split outside the training minimum and maximum of each feature."""
    marked = df.withColumn("_s", support(df, features, split, train))
    flags = [
        ((F.col(f) < F.col("_s")[f"{f}__lo"]) | (F.col(f) > F.col("_s")[f"{f}__hi"])) for f in features
    ]
    return marked.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(f"{f}_out") for f, c in zip(features, flags)],
    )


def quantile_edges(df: DataFrame, value: str, probs: list[float], keys: list[str] = []) -> DataFrame:
    """Exact linear-interpolated quantiles.  ``percentile`` keeps one counter per distinct value,
    merged from partial maps; see :func:`quantiles_by_rank` for groups with too many of those."""
    ag = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("edges")
    return df.groupBy(*keys).agg(ag) if keys else df.agg(ag)


def quantiles_by_rank(df: DataFrame, value: str, probs: list[float], keys: list[str], limit=None) -> DataFrame:
    """The same quantiles from running counts over distinct values, for groups of any size."""
    from screenloom.functions.ordered import GROUP_LIMIT, running

    ties = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    ties = running(ties, keys, [value], ["c"], GROUP_LIMIT if limit is None else limit)
    out = None
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("c_total") - 1)
        for name, idx in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            hit = (F.col("c_before") <= idx) & (idx < F.col("c_before") + F.col("c"))
            ties = ties.withColumn(name, F.when(hit, F.col(value)))
        ties = ties.withColumn(f"w{i}", at - F.floor(at))
    n = range(len(probs))
    agg = ties.groupBy(*keys).agg(
        *[F.max(f"lo{i}").alias(f"lo{i}") for i in n],
        *[F.max(f"hi{i}").alias(f"hi{i}") for i in n],
        *[F.max(f"w{i}").alias(f"w{i}") for i in n],
    )
    return agg.select(
        *keys,
        F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}") for i in n]).alias("edges"),
    )


def bin_index(value, edges) -> Column:
    """Number of edges strictly below the value: 0..len(edges)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.size(F.filter(edges, lambda e: v > e))


def equal_width_bin(value, lo, hi, bins: int) -> Column:
    """0-based equal-width bin; the maximum belongs to the last one."""
    at = F.floor(F.try_divide((value - lo) * F.lit(bins), hi - lo)).cast("int")
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))


def id_registry(names: list[DataFrame], control: str, name="target") -> DataFrame:
    """Distinct names in order, numbered from 0, the control label last unless it is listed.

    Only distinct names are put in order, never the rows they label."""
    from screenloom.functions.ordered import ordinal

    allnames = names[0].select(name)
    for d in names[1:]:
        allnames = allnames.unionByName(d.select(name))
    spark = allnames.sparkSession
    marked = (
        allnames.withColumn("late", F.lit(0))
        .unionByName(spark.range(1).select(F.lit(control).alias(name), F.lit(1).alias("late")))
        .groupBy(name).agg(F.min("late").alias("late"))
    )
    return ordinal(marked, [], ["late", name], "target_id").select(name, "target_id")


def evenly_spaced(df: DataFrame, order: str, m: int) -> DataFrame:
    """Rows at the floors of m evenly spaced positions of the sorted keys, first to last."""
    from screenloom.functions.ordered import ordinal

    pos = ordinal(df, [], [order], "pos")
    # position p is taken when some step i in 0..m-1 has floor(i * (n - 1) / (m - 1)) = p
    n = F.col("pos_n")
    step = F.ceil(F.col("pos") * F.lit(m - 1) / F.greatest(n - 1, F.lit(1)))
    hit = (F.floor(step * (n - 1) / F.lit(max(m - 1, 1))) == F.col("pos")) & (step <= m - 1)
    return pos.where(hit).drop("pos_n")
