"""Streaming queries, run to the end of the available data."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from screenloom.plans.registry import query, r
from screenloom.plans.sqltext import SCREEN, rd
from screenloom.session import durable, shared_dir
from screenloom.sources import roles
from screenloom.streaming import accumulate as A

CHUNKS = "chunk_id string, cell_id bigint, construct string, gene_idx int, cnt double"
GENES = f"""WITH {SCREEN}, n AS (SELECT target, count(*) AS n FROM cells GROUP BY 1),
  mu AS (SELECT target, gene_idx, any_value(n) AS n, sum(v) / any_value(n) AS mean FROM norm JOIN cells USING (cell_id) JOIN n USING (target) GROUP BY ALL)
  SELECT a.target AS construct, a.gene_idx, a.n, {rd('a.mean')} AS mean, {rd('a.mean - coalesce(b.mean, 0)')} AS delta
  FROM mu a LEFT JOIN mu b ON b.target = 'T0' AND b.gene_idx = a.gene_idx WHERE a.target <> 'T0'"""


def _root(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _rows(spark, d):
    c = roles.cells(spark, d).join(roles.counts(spark, d), "cell_id", "left")
    chunk = F.concat_ws("-", "batch", F.pmod("cell_id", F.lit(4)))
    return c.select("batch", chunk.alias("chunk_id"), "cell_id", F.col("target").alias("construct"), "gene_idx", F.col("cnt").cast("double").alias("cnt"))


def _deliver(rows, path, where="true", files=2):
    """Write the cells with their counts as chunks, a year's cells in four; each chunk lies in several files."""
    rows = rows.where(where).drop("batch").withColumn("_file", F.concat_ws("-", F.pmod(F.col("cell_id") / 4, F.lit(files)).cast("int"), "chunk_id"))
    rows.repartition("_file").write.partitionBy("_file").parquet(path)


def _run_chunks(spark, rows, landing, root):
    stream = A.chunk_stream(spark, landing, CHUNKS, per_trigger=20)
    outputs = {"sums": A.gene_sums, "cells": A.cell_counts}
    manifest = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))
    A.accumulate(stream, f"{root}/state", f"{root}/checkpoint", outputs, "chunk_id", ["cell_id", "gene_idx"], A.refuse_bad_counts, manifest).awaitTermination()


def _fold(spark, root):
    A.fold(spark, f"{root}/state", "sums", ["construct", "gene_idx"])
    A.fold(spark, f"{root}/state", "cells", ["construct"])


def _genes(spark, root):
    out = A.finalize_genes(spark, f"{root}/state", roles.CONTROL)
    return out.select("construct", "gene_idx", "n", r("mean", "mean"), r("delta", "delta"))


@query("T1_incremental_group_mean", GENES)
def t1(spark, d):
    """Several micro-batches of sparse counts, normalised chunk by chunk; a chunk's files reach different batches."""
    root, rows = _root(spark), durable(_rows(spark, d))
    _deliver(rows, f"{root}/landing/first")
    _run_chunks(spark, rows, f"{root}/landing", root)
    return _genes(spark, root)


@query("T2_idempotent_replay", GENES)
def t2(spark, d):
    """Every chunk is delivered twice, cut into other files the second time, partly to the same and partly to later batches."""
    root, rows = _root(spark), durable(_rows(spark, d))
    _deliver(rows, f"{root}/landing/first")
    _deliver(rows, f"{root}/landing/again", files=1)
    _run_chunks(spark, rows, f"{root}/landing", root)
    return _genes(spark, root)


@query("T3_resume_from_checkpoint", GENES)
def t3(spark, d):
    """Stopped after part of the chunks and folded, resumed when the rest and a repeat of the part have come, folded again."""
    root, rows = _root(spark), durable(_rows(spark, d))
    _deliver(rows, f"{root}/landing/part", "batch < '1998'")
    _run_chunks(spark, rows, f"{root}/landing", root)
    _fold(spark, root)
    _deliver(rows, f"{root}/landing/rest", "batch >= '1998'", files=1)
    _deliver(rows, f"{root}/landing/repeat", "batch < '1998'", files=1)
    _run_chunks(spark, rows, f"{root}/landing", root)
    _fold(spark, root)
    return _genes(spark, root)


@query("T4_finalize_guards", """SELECT * FROM (SELECT 'no_control' AS check_name, CAST(count(*) FILTER (event_type = 'view') = 0 AS BIGINT) AS n_bad, count(*) FILTER (event_type = 'view') > 0 AS pass FROM events)
  UNION ALL SELECT 'no_treated', CAST(count(*) FILTER (event_type <> 'view') = 0 AS BIGINT), count(*) FILTER (event_type <> 'view') > 0 FROM events
  UNION ALL SELECT 'zero_count', CAST(0 AS BIGINT), true""")
def t4(spark, d):
    root = _run_events(spark, d)
    return A.finalize_checks(A.read_state(spark, f"{root}/state", ["construct"]), "construct", "view")


def _run_events(spark, d, **more):
    root = _root(spark)
    s = A.event_stream(spark, d).select(F.col("event_id").alias("cell_id"), F.col("event_type").alias("construct"), "value")
    outputs = {"sums": lambda b: A.partial_sums(b, ["construct"], "value"), **more}
    A.accumulate(s, f"{root}/state", f"{root}/checkpoint", outputs).awaitTermination()
    return root


@query("T5_two_outputs_one_pass", f"SELECT event_type AS construct, count(*) AS n, {rd('sum(value)')} AS s, count(*) FILTER (event_id % 10 = 0) AS n_subset FROM events GROUP BY 1")
def t5(spark, d):
    root = _run_events(spark, d, subset=lambda b: b.where(F.col("cell_id") % 10 == 0).select("cell_id", "construct", "value"))
    sub = A.read_output(spark, f"{root}/state", "subset").groupBy("construct").agg(F.count("*").alias("n_subset"))
    return A.read_state(spark, f"{root}/state", ["construct"]).join(sub, "construct", "left").select("construct", "n", r("s", "s"), "n_subset")


@query("T6_progress_rate", "SELECT CAST(count(*) AS BIGINT) AS n_state, count(*) AS n_reported, true AS has_rate FROM events")
def t6(spark, d):
    """Rows and time of every micro-batch, from what the batches wrote themselves."""
    root = _run_events(spark, d, progress=lambda b: b.agg(F.count(F.lit(1)).alias("rows"), F.min(F.current_timestamp()).alias("at")))
    total = A.read_state(spark, f"{root}/state", ["construct"]).agg(F.sum("n").alias("n_state"))
    p = A.read_output(spark, f"{root}/state", "progress").agg(F.sum("rows").alias("n_reported"), (F.count("at") > 0).alias("has_rate"))
    return total.select("n_state", p.select("n_reported").scalar().alias("n_reported"), p.select("has_rate").scalar().alias("has_rate"))
