"""Group means and control-subtracted deltas over long-sparse values.

Absent values are zeros: sums run over stored values, denominators come from the cell table.
"""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from screenloom.functions.sizes import broadcast_if_small, small


def group_sums(values: DataFrame, cells: DataFrame, keys: list[str], tasks: list[int] = []) -> DataFrame:
    """keys, gene_idx, s: the one pass over the stored values.

    Partial sums run before the shuffle, so a group of any size spreads over all mappers.  On an axis so wide that groups
    hardly repeat a gene, partial sums save nothing: ``tasks`` then says to how many tasks entries are dealt before they are summed."""
    met = values.join(cells.select("cell_id", *keys), "cell_id")
    return _dealt(met, keys, tasks).groupBy(*keys, "gene_idx").agg(F.sum("v").alias("s"))


def _dealt(df: DataFrame, keys: list[str], tasks: list[int]) -> DataFrame:
    return df.repartition(*tasks, *keys, "gene_idx") if tasks else df


def means(sums: DataFrame, sizes: DataFrame, keys: list[str], tasks: list[int] = []) -> DataFrame:
    """keys, gene_idx, mean, n_cells for the groups in ``sizes`` (keys, n_cells); coarser ``keys``
    than those of the sums add them up first.  ``tasks`` as in :func:`group_sums`; dealt sums stay where they are and sizes go to them."""
    s = _dealt(sums, keys, tasks).groupBy(*keys, "gene_idx").agg(F.sum("s").alias("s"))
    return s.join(broadcast_if_small(sizes) if tasks else sizes, keys).select(
        *keys, "gene_idx", (F.col("s") / F.col("n_cells")).alias("mean"), "n_cells"
    )


def group_mean(values: DataFrame, cells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    return group_sums(values, cells, keys).join(sizes, keys).select(
        *keys, "gene_idx", (F.col("s") / F.col("n_cells")).alias("mean"), "n_cells"
    )


SALT = 64
#: Genes that travel as one array.
GENES_IN_ARRAY = 4096


def _every_gene(groups: DataFrame, baseline: DataFrame, keys: list[str], on: list[str], tasks: list[int]) -> DataFrame:
    """Each group with its baseline's genes.  A join on the baseline's few keys alone would write a hot batch's groups x genes
    from one task.  A small baseline goes as one array per key to where the groups are.  To a larger one, dealt by key and
    gene, go the groups; where these are not small either, the baseline is repeated per salt in arrays of bounded length and the
    groups spread over the salts.  So no row grows with the genes."""
    if small(baseline.select(F.struct("gene_idx", "mean").alias("_genes"))):
        packed = baseline.groupBy(*on).agg(F.collect_list(F.struct("gene_idx", "mean")).alias("_genes"))
        return groups.join(F.broadcast(packed), on).select(*groups.columns, F.inline("_genes"))
    if small(groups):
        spread = baseline.repartition(*(tasks or [SALT]), *on, "gene_idx")
        return spread.join(F.broadcast(groups), on).select(*groups.columns, "gene_idx", "mean")
    part = F.floor(F.col("gene_idx") / GENES_IN_ARRAY).alias("_part")
    packed = baseline.groupBy(*on, part).agg(F.collect_list(F.struct("gene_idx", "mean")).alias("_genes"))
    left = groups.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int"))
    right = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right, [*on, "_salt"]).select(*groups.columns, F.inline("_genes"))


def delta(profile: DataFrame, sizes: DataFrame, baseline: DataFrame, keys: list[str], on: list[str], tasks: list[int] = []) -> DataFrame:
    """``mean - baseline`` for every gene that either side has; ``tasks`` as in :func:`group_sums`.

    Profile rows and negated baseline rows are stacked and summed: one shuffle on (group, gene)
    does the full outer join, and no group is pulled onto the baseline's few keys.
    """
    minus = _every_gene(sizes.select(*keys), baseline, keys, on, tasks).select(
        *keys, "gene_idx", (-F.col("mean")).alias("part")
    )
    stacked = profile.select(*keys, "gene_idx", F.col("mean").alias("part")).unionByName(minus)
    return _dealt(stacked, keys, tasks).groupBy(*keys, "gene_idx").agg(F.sum("part").alias("delta"))


def vector_mean(emb: DataFrame, keys: list[str], col: str = "emb") -> DataFrame:
    """Mean vector and row count per group; vectors are summed whole inside the JVM."""
    return emb.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(col)))).alias("mean"),
        F.count(F.lit(1)).alias("n_cells"),
    )


def embedding_delta(
    emb: DataFrame, control: str, scope: list[str], construct="construct", min_cells: int = 1
) -> DataFrame:
    """Mean embedding of a construct minus the control mean, inside each ``scope`` value.

    ``scope=["batch"]`` takes the same batch's controls; ``scope=[]`` the pooled ones, one vector
    read as a scalar subquery.
    """
    keys = [*scope, construct]
    groups = vector_mean(emb.where(F.col(construct) != control), keys).where(F.col("n_cells") >= min_cells)
    base = vector_mean(emb.where(F.col(construct) == control), scope).select(
        *scope, F.col("mean").alias("base")
    )
    both = groups.join(base, scope) if scope else groups.withColumn("base", base.select("base").scalar())
    return both.select(
        *keys, "n_cells", F.zip_with("mean", "base", lambda a, b: a - b).alias("z")
    )
