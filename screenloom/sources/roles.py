"""The supplied tables in the roles the operators expect."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from screenloom.sources.tables import read

CONTROL = "T0"
N_TARGETS = 32
N_GENES = 64
#: Entries that one task groups.
ENTRIES_IN_TASK = 1_000_000


def more_tasks(spark: SparkSession, entries: int) -> list[int]:
    """The number of tasks by which none groups more than ``ENTRIES_IN_TASK``, or nothing while the session's number does."""
    tasks = -(-entries // ENTRIES_IN_TASK)
    return [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def entries(spark: SparkSession, d: str) -> int:
    """Entries before grouping, from the files' footers."""
    return read(spark, d, "lineitem", ["l_orderkey"]).count()


def cells(spark: SparkSession, d: str, targets: int = N_TARGETS) -> DataFrame:
    """cell_id, batch, target, split; target T0 is the control."""
    o = read(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    digit = F.col("o_orderkey") % 10
    return o.select(
        F.col("o_orderkey").alias("cell_id"),
        F.year("o_orderdate").cast("string").alias("batch"),
        F.concat(F.lit("T"), (F.col("o_custkey") % targets).cast("string")).alias("target"),
        F.when(digit < 6, "train").when(digit < 8, "val").otherwise("test").alias("split"),
    )


def counts(spark: SparkSession, d: str, genes: int | None = N_GENES) -> DataFrame:
    """cell_id, gene_idx, cnt: one row per non-zero entry; ``genes`` None keeps every part as a gene.

    Entries hardly repeat, so sums before the shuffle would save nothing; dealt by cell, one shuffle
    serves this grouping, the per-cell totals and the join with the cell table.  Beyond ``ENTRIES_IN_TASK`` a task, counted
    from the files' footers, it has more tasks, so that none holds more as the table grows."""
    li = read(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    more = more_tasks(spark, entries(spark, d))
    return (
        li.select(
            F.col("l_orderkey").alias("cell_id"),
            (F.col("l_partkey") % genes if genes else F.col("l_partkey")).cast("int").alias("gene_idx"),
            F.col("l_quantity").alias("q"),
        )
        .repartition(*more, "cell_id")
        .groupBy("cell_id", "gene_idx")
        .agg(F.sum("q").alias("cnt"))
    )


def own_gene() -> F.Column:
    """Target T<k> acts on gene k."""
    return F.substring("target", 2, 9).cast("int")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """row_key, context, cluster, y, pred_a, pred_b on comparable scales."""
    o = read(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    li = read(spark, d, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"])
    c = read(spark, d, "customer", ["c_custkey", "c_acctbal"])
    net = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    )
    return (
        o.join(net, o.o_orderkey == net.l_orderkey, "left")
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            F.col("o_orderkey").alias("row_key"),
            F.year("o_orderdate").alias("context"),
            F.col("o_custkey").alias("cluster"),
            (F.col("o_totalprice") / 100000.0).alias("y"),
            F.round(F.coalesce(F.col("net"), F.lit(0.0)) / 100000.0, 9).alias("pred_a"),
            (F.col("c_acctbal") / 10000.0).alias("pred_b"),
        )
    )


def cell_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, construct, batch, emb; construct L0 is the control."""
    e = read(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("cell_id"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("construct"),
        (F.col("vec_id") % 5).cast("int").alias("batch"),
        F.col("embedding").cast("array<double>").alias("emb"),
    )
