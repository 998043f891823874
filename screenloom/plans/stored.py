"""Stored variants and result documents."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from screenloom.operators import features as X
from screenloom.plans.build import A8SQL, KEYS, Screen, assembled
from screenloom.plans.registry import query, r
from screenloom.plans.scoring import ADSQL, R2, labels_of
from screenloom.plans.sqltext import BULK, FULL, SCORES, rd
from screenloom.session import shared_dir
from screenloom.sources import roles, tables, variants


@query("S5_stored_variant_reuse", f"WITH {FULL} SELECT split, batch, count(*) AS n, {rd('sum(delta)')} AS total FROM delta GROUP BY ALL")
def s5(spark, d):
    """Profiles are written by split and batch, then read back twice; the second call must not build."""
    root = f"{shared_dir(spark)}/variants/{uuid.uuid4().hex}"
    variants.reuse_variant(spark, root, "delta", "all", roles.N_GENES, lambda: Screen(spark, d).delta)

    def again():
        raise AssertionError("a stored variant was built again")

    p = variants.reuse_variant(spark, root, "delta", "all", roles.N_GENES, again)
    return p.groupBy("split", "batch").agg(F.count("*").alias("n"), r(F.sum("delta"), "total"))


ASSEMBLED = f"""{ADSQL}, {A8SQL[len(BULK) + 2:].replace('dense AS', 'dense8 AS').replace('FROM dense GROUP', 'FROM dense8 GROUP').replace('b AS (', 'b8 AS (').replace('FROM b GROUP', 'FROM b8 GROUP')},
  dn AS (SELECT g.gene_idx, coalesce(mean, 0) AS x FROM (SELECT * FROM sizes WHERE split = 'train') s CROSS JOIN (SELECT DISTINCT gene_idx FROM profile) g LEFT JOIN profile p USING (split, batch, target, gene_idx)),
  hv AS (SELECT gene_idx FROM (SELECT gene_idx, var_pop(x) AS v FROM dn GROUP BY 1) ORDER BY v DESC, gene_idx LIMIT 16),
  cx AS (SELECT gene_idx FROM ratio ORDER BY CAST(score AS FLOAT) DESC, gene_idx LIMIT 16),
  ch AS (SELECT 'hvg' AS sel, gene_idx, CAST(row_number() OVER (ORDER BY gene_idx) - 1 AS INTEGER) AS pos FROM hv UNION ALL SELECT 'crossctx', gene_idx, CAST(row_number() OVER (ORDER BY gene_idx) - 1 AS INTEGER) FROM cx),
  vl AS (SELECT 'raw' AS tr, split, batch, target, gene_idx, mean AS v FROM profile UNION ALL SELECT 'delta', split, batch, target, gene_idx, delta FROM delta),
  ti AS (SELECT target, row_number() OVER (ORDER BY late, target) - 1 AS target_id FROM (SELECT target, CASE WHEN target = 'T0' THEN 1 ELSE 0 END AS late FROM cells GROUP BY ALL)),
  ci AS (SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS context_id FROM (SELECT DISTINCT batch FROM cells)),
  li AS (SELECT DISTINCT 'T' || CAST(p_partkey % 64 AS VARCHAR) AS target FROM part WHERE p_size > 48)
  SELECT tr || '_' || sel AS variant, s.split, s.batch, s.target, target_id, context_id, s.n_cells, {rd('y')} AS y, pos, {rd('coalesce(v, 0)')} AS value
  FROM sizes s JOIN li USING (target) JOIN ti USING (target) JOIN ci USING (batch) LEFT JOIN labels_y l ON l.split = s.split AND l.batch = s.batch AND l.target = s.target
  CROSS JOIN ch CROSS JOIN (SELECT DISTINCT tr FROM vl) t LEFT JOIN vl ON vl.tr = t.tr AND vl.split = s.split AND vl.batch = s.batch AND vl.target = s.target AND vl.gene_idx = ch.gene_idx
  WHERE NOT (t.tr = 'raw' AND sel = 'hvg')"""


@query("S5_assembled_profiles", f"WITH {ASSEMBLED.replace('t.tr', 't.tr').replace('SELECT tr ||', 'SELECT t.tr ||')}")
def s5a(spark, d):
    """The stored table of profiles: chosen genes as a vector with label, ids and counts; three variants,
    the forbidden fourth not among them; written, then read back.

    Sizes, profiles and labels serve several variants, so each is written once: as one plan, all variants with their own copies
    of every stage took most of a small driver's memory."""
    from screenloom.session import durable
    s = Screen(spark, d)
    s.norm, s.sizes = durable(s.norm), durable(s.sizes)
    s.profile = durable(s.profile)
    labels = durable(labels_of(s).select(*KEYS, "y"))
    train = F.col("split") == "train"
    hvg = durable(X.top_genes(X.gene_stats(s.profile.where(train), s.sizes.where(train)), "var", 16))
    ratio = X.cross_context_ratio(s.profile.where(train), s.sizes.where(train)).withColumn("score32", F.col("score").cast("float"))
    cross = durable(X.top_genes(ratio, "score32", 16))
    delta = durable(s.delta)
    listed = tables.read(spark, d, "part", ["p_partkey", "p_size"]).where("p_size > 48").select((F.col("p_partkey") % roles.N_GENES).alias("gene_idx"))
    out = durable(assembled(s, labels, listed, [
        ("raw_crossctx", s.profile, "mean", cross), ("delta_hvg", delta, "delta", hvg), ("delta_crossctx", delta, "delta", cross)]))
    return out.select("variant", *KEYS, "target_id", "context_id", "n_cells", r("y", "y"), F.posexplode("profile").alias("pos", "value")).select(
        "variant", *KEYS, "target_id", "context_id", "n_cells", "y", "pos", r("value", "value"))


@query("S6_result_tables_out", f"WITH {SCORES} SELECT CAST(context AS BIGINT) AS context, {rd(R2.format(p='pred_b'))} AS r2 FROM scores GROUP BY 1")
def s6(spark, d):
    from screenloom.functions import stats as S
    path = f"{shared_dir(spark)}/results/{uuid.uuid4().hex}"
    out = roles.scores(spark, d).groupBy(F.col("context").cast("bigint").alias("context")).agg(r(S.r2("y", "pred_b"), "r2"))
    tables.write_results(out, path, "json")
    return spark.read.schema("context bigint, r2 double").json(path)


@query("S7_variant_guard", "SELECT 2 AS n_refused, 'variants/delta_hvg' AS resolved, count(*) AS n_cells FROM orders")
def s7(spark, d):
    """Forbidden requests are refused before any read; the allowed one resolves."""
    refused = 0
    for args in (("raw", "hvg"), ("raw", "nonsense")):
        try:
            variants.variant_path("variants", *args)
        except ValueError:
            refused += 1
    ok = variants.variant_path("variants", "delta", "hvg")
    n = roles.cells(spark, d).agg(F.count("*").alias("n_cells"))
    return n.select(F.lit(refused).alias("n_refused"), F.lit(ok).alias("resolved"), "n_cells")
