"""Matched pairs between contexts and representation metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.functions import stats as S, vector as V
from screenloom.functions.ordered import average_rank, largest_group
from screenloom.operators import blocks as K, pairs as P
from screenloom.plans.registry import query, r
from screenloom.plans.scoring import R2, avg_rank, pear
from screenloom.plans.sqltext import EMB, SCORES, rd
from screenloom.sources import roles

FIRST = "fi AS (SELECT context, cluster, min(row_key) AS row_key FROM scores GROUP BY ALL)"
T1 = f"{FIRST}, t1 AS (SELECT a.context AS ctx_a, b.context AS ctx_b, a.row_key AS row_a, b.row_key AS row_b, 1.0::DOUBLE AS weight, CAST(1 AS INTEGER) AS tier FROM fi a JOIN fi b USING (cluster) WHERE a.context < b.context)"


@query("J9_tier1_exact_pairs", f"WITH {SCORES}, {T1} SELECT * FROM t1")
def j9(spark, d):
    return P.tier1(roles.scores(spark, d), "context", "row_key", "cluster")


def ctx_rows(spark, d):
    """Contexts 0 and 1 share sample ids, 2 shares clusters only, 3 neither."""
    s = roles.scores(spark, d)
    c = (F.col("row_key") % 4).cast("int")
    return s.select(
        "row_key", c.alias("context"), "y", "pred_a", "pred_b",
        F.when(c < 2, F.col("cluster")).otherwise(-F.col("row_key") - 1).alias("sample"),
        F.when(c < 3, F.col("cluster") % 50).otherwise(1000 + F.col("row_key")).alias("bucket"),
    )


CTX = f"""{SCORES}, cx AS (SELECT row_key, CAST(row_key % 4 AS INTEGER) AS context, y, pred_a, pred_b, CASE WHEN row_key % 4 < 2 THEN cluster ELSE -row_key - 1 END AS sample,
    CASE WHEN row_key % 4 < 3 THEN cluster % 50 ELSE 1000 + row_key END AS bucket FROM scores),
  f1 AS (SELECT context, sample, min(row_key) AS row_key FROM cx GROUP BY ALL),
  t1 AS (SELECT a.context AS ctx_a, b.context AS ctx_b, a.row_key AS row_a, b.row_key AS row_b, 1.0::DOUBLE AS weight, CAST(1 AS INTEGER) AS tier FROM f1 a JOIN f1 b USING (sample) WHERE a.context < b.context),
  ps AS (SELECT context, row_key, bucket, row_number() OVER (PARTITION BY context, bucket ORDER BY row_key) AS i FROM cx),
  t2 AS (SELECT a.context AS ctx_a, b.context AS ctx_b, a.row_key AS row_a, b.row_key AS row_b, 0.5::DOUBLE AS weight, CAST(2 AS INTEGER) AS tier FROM ps a JOIN ps b USING (bucket, i)
    WHERE a.context < b.context AND (a.context, b.context) NOT IN (SELECT ctx_a, ctx_b FROM t1)),
  dn AS (SELECT ctx_a, ctx_b FROM t1 UNION SELECT ctx_a, ctx_b FROM t2),
  cp AS (SELECT a.c AS ctx_a, b.c AS ctx_b FROM (SELECT DISTINCT context AS c FROM cx) a, (SELECT DISTINCT context AS c FROM cx) b WHERE a.c < b.c AND (a.c, b.c) NOT IN (SELECT ctx_a, ctx_b FROM dn)),
  nb AS (SELECT cp.ctx_a, cp.ctx_b, x.row_key AS row_a, min((abs(x.y - z.y), z.row_key)) AS best FROM cp JOIN cx x ON x.context = cp.ctx_a JOIN cx z ON z.context = cp.ctx_b GROUP BY ALL),
  t3 AS (SELECT ctx_a, ctx_b, row_a, best[2] AS row_b, 0.25::DOUBLE AS weight, CAST(3 AS INTEGER) AS tier FROM nb),
  allp AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""


def cascade(spark, d):
    return P.cascade(ctx_rows(spark, d), "context", "row_key", "sample", "bucket", "y")


@query("J10_tier2_cluster_pairs", f"WITH {CTX} SELECT * FROM t2")
def j10(spark, d):
    c = ctx_rows(spark, d)
    return P.tier2(c, "context", "row_key", "bucket", P.covered(P.tier1(c, "context", "row_key", "sample")))


@query("J11_tier3_nearest_pairs", f"WITH {CTX} SELECT * FROM t3")
def j11(spark, d):
    return cascade(spark, d).where("tier = 3")


@query("J11_tier3_nearest_with_ties", f"""WITH {SCORES}, g AS (SELECT row_key, CAST(row_key % 4 AS INTEGER) AS context, floor(y * 4) AS u FROM scores),
  m AS (SELECT a.context AS ctx_a, b.context AS ctx_b, a.row_key AS row_a, min((abs(a.u - b.u), b.row_key), 3) AS bests FROM g a JOIN g b ON a.context < b.context GROUP BY ALL),
  o AS (SELECT ctx_a, ctx_b, row_a, unnest(bests) AS best FROM m)
  SELECT ctx_a, ctx_b, row_a, best[2] AS row_b, 0.25::DOUBLE AS weight, CAST(3 AS INTEGER) AS tier FROM o""")
def j11t(spark, d):
    """Three neighbours where a few coordinates hold all rows, so every place is a tie."""
    s = roles.scores(spark, d)
    g = s.select("row_key", (F.col("row_key") % 4).cast("int").alias("context"), F.floor(F.col("y") * 4).cast("double").alias("u"))
    none = g.select(F.col("context").alias("ctx_a"), F.col("context").alias("ctx_b")).where("false")
    return P.tier3(g, "context", "row_key", "u", none, k=3)


@query("J12_tier_cascade", f"""WITH {CTX} SELECT CAST(t.tier AS INTEGER) AS tier, count(DISTINCT (ctx_a, ctx_b)) FILTER (ctx_a IS NOT NULL) AS n_ctx_pairs, count(ctx_a) AS n_row_pairs
  FROM (SELECT unnest([1, 2, 3]) AS tier) t LEFT JOIN allp USING (tier) GROUP BY 1""")
def j12(spark, d):
    return P.tier_counts(cascade(spark, d))


@query("J11_nearest_vector_pairs", f"""WITH {EMB}, dd AS (SELECT a.batch AS ctx_a, b.batch AS ctx_b, a.cell_id AS row_a, b.cell_id AS row_b, sum((a.x - b.x) * (a.x - b.x)) AS d2
    FROM embl a JOIN embl b ON a.d = b.d AND a.batch < b.batch GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY ctx_a, ctx_b, row_a ORDER BY d2, row_b) AS rn FROM dd)
  SELECT ctx_a, ctx_b, row_a, row_b, {rd('d2')} AS d2 FROM o WHERE rn <= 2""")
def j11v(spark, d):
    out = K.nearest(roles.cell_embeddings(spark, d), "batch", "cell_id", "emb", k=2)
    return out.select("ctx_a", "ctx_b", "row_a", "row_b", r("d2", "d2"))


RC = f"""{CTX}, vl AS (SELECT p.*, a.pred_b AS a, b.pred_b AS b FROM allp p JOIN cx a ON a.row_key = row_a JOIN cx b ON b.row_key = row_b),
  rk AS (SELECT *, {avg_rank('a', 'ctx_a, ctx_b, tier')} AS ra, {avg_rank('b', 'ctx_a, ctx_b, tier')} AS rb FROM vl),
  pc AS (SELECT ctx_a, ctx_b, tier, weight, {pear('ra', 'rb')} AS rho FROM rk GROUP BY ALL)"""


def _rc(spark, d):
    c = ctx_rows(spark, d)
    # every tier makes at most one pair per row of the first context
    most = largest_group(c, ["context"])
    return P.rank_consistency(P.matched_values(cascade(spark, d), c, "row_key", "pred_b"), bound=most)


@query("M9_rank_consistency", f"WITH {RC} SELECT {rd('sum(weight * rho) / sum(CASE WHEN rho IS NOT NULL THEN weight END)')} AS rho, count(*) AS n_ctx_pairs FROM pc")
def m9(spark, d):
    return _rc(spark, d).where("tier = 0").select(r("rho", "rho"), "n_ctx_pairs")


@query("M10_rank_consistency_by_tier", f"WITH {RC} SELECT CAST(coalesce(tier, 0) AS INTEGER) AS tier, {rd('sum(weight * rho) / sum(CASE WHEN rho IS NOT NULL THEN weight END)')} AS rho, count(*) AS n_ctx_pairs FROM pc GROUP BY GROUPING SETS ((tier), ())")
def m10(spark, d):
    return _rc(spark, d).select("tier", r("rho", "rho"), "n_ctx_pairs")


@query("M11_pairwise_order_agreement", f"""WITH {SCORES}, g AS (SELECT context, row_key, y AS a, pred_b AS b FROM scores),
  p AS (SELECT x.context, count(*) FILTER ((x.a < z.a AND x.b < z.b) OR (x.a > z.a AND x.b > z.b)) AS c, count(*) FILTER ((x.a < z.a AND x.b > z.b) OR (x.a > z.a AND x.b < z.b)) AS q
    FROM g x JOIN g z ON x.context = z.context AND x.row_key < z.row_key GROUP BY 1)
  SELECT context, c AS n_concordant, q AS n_discordant, {rd('c / (c + q)')} AS agreement FROM p""")
def m11(spark, d):
    s = roles.scores(spark, d).select("context", F.col("y").alias("a"), F.col("pred_b").alias("b"))
    return P.order_agreement(s, ["context"], "a", "b").select("context", "n_concordant", "n_discordant", r("agreement", "agreement"))


IMP = f"""{EMB}, yy AS (SELECT cell_id, sum(x) AS y FROM embl WHERE d <= 32 GROUP BY 1),
  imp AS (SELECT batch, d, abs(covar_pop(x, y) * count(*)) / sqrt(var_pop(x) * count(*) * var_pop(y) * count(*) + 1e-12) AS imp FROM embl JOIN yy USING (cell_id) GROUP BY ALL)"""


def importance(spark, d):
    e = roles.cell_embeddings(spark, d).withColumn("y", V.vsum(F.slice("emb", 1, 32)))
    long = e.select("batch", "y", F.posexplode("emb").alias("j", "x"))
    n = F.count("*")
    return long.groupBy("batch", "j").agg(
        (F.abs(F.covar_pop("x", "y") * n) / F.sqrt(F.var_pop("x") * n * F.var_pop("y") * n + 1e-12)).alias("imp"))


@query("M12_feature_importance", f"WITH {IMP} SELECT batch, CAST(d - 1 AS INTEGER) AS j, {rd('imp')} AS imp FROM imp")
def m12(spark, d):
    return importance(spark, d).select("batch", "j", r("imp", "imp"))


@query("M13_importance_stability", f"""WITH {IMP}, rk AS (SELECT batch, d, {avg_rank('imp', 'batch')} AS rk FROM imp),
  pr AS (SELECT a.batch AS x, b.batch AS z, {pear('a.rk', 'b.rk')} AS rho FROM rk a JOIN rk b USING (d) WHERE a.batch < b.batch GROUP BY ALL)
  SELECT count(rho) AS n_pairs, {rd('avg(rho)')} AS stability FROM pr""")
def m13(spark, d):
    k = average_rank(importance(spark, d), ["batch"], {"rk": "imp"}, limit=None)
    a, b = k.select("j", F.col("batch").alias("x"), F.col("rk").alias("ra")), k.select("j", F.col("batch").alias("z"), F.col("rk").alias("rb"))
    per = a.join(b, "j").where("x < z").groupBy("x", "z").agg(S.pearson("ra", "rb").alias("rho"))
    return per.agg(F.count("rho").alias("n_pairs"), r(F.avg("rho"), "stability"))


@query("M14_direction_recovery", f"""WITH {IMP}, w0 AS (SELECT d, CASE WHEN d <= 32 THEN 1.0 ELSE 0.0 END AS w FROM (SELECT unnest(range(1, 65)) AS d)),
  cv AS (SELECT batch, d, covar_pop(x, y) AS w FROM embl JOIN yy USING (cell_id) GROUP BY ALL)
  SELECT batch, {rd('abs(sum(cv.w * w0.w)) / (sqrt(sum(cv.w * cv.w)) * sqrt(sum(w0.w * w0.w)))')} AS cosine FROM cv JOIN w0 USING (d) GROUP BY 1""")
def m14(spark, d):
    e = roles.cell_embeddings(spark, d).withColumn("y", V.vsum(F.slice("emb", 1, 32)))
    cv = e.select("batch", "y", F.posexplode("emb").alias("j", "x")).groupBy("batch", "j").agg(F.covar_pop("x", "y").alias("w"))
    w0 = F.when(F.col("j") < 32, 1.0).otherwise(0.0)
    return cv.groupBy("batch").agg(r(F.try_divide(
        F.abs(F.sum(F.col("w") * w0)), F.sqrt(F.sum(F.col("w") * F.col("w"))) * F.sqrt(F.sum(w0 * w0))), "cosine"))


D2 = f"""{EMB}, pr AS (SELECT a.cell_id AS i, b.cell_id AS j, any_value(a.batch) AS ba, any_value(b.batch) AS bb, sum((a.x - b.x) * (a.x - b.x)) AS d2
    FROM embl a JOIN embl b ON a.d = b.d GROUP BY a.cell_id, b.cell_id),
  cp AS (SELECT a.c AS pa, b.c AS pb FROM (SELECT DISTINCT batch AS c FROM emb) a, (SELECT DISTINCT batch AS c FROM emb) b WHERE a.c < b.c)"""
MMD = f"""{D2}, bw AS (SELECT pa, pb, greatest(quantile_cont(d2, 0.5), 1e-12) AS m FROM cp JOIN pr ON ba IN (pa, pb) AND bb IN (pa, pb) WHERE i < j GROUP BY ALL),
  mm AS (SELECT pa, pb, any_value(m) AS m, avg(CASE WHEN ba = pa AND bb = pa THEN exp(-d2 / (2 * m)) END) + avg(CASE WHEN ba = pb AND bb = pb THEN exp(-d2 / (2 * m)) END)
     - 2 * avg(CASE WHEN ba = pa AND bb = pb THEN exp(-d2 / (2 * m)) END) AS mmd2 FROM bw JOIN pr ON ba IN (pa, pb) AND bb IN (pa, pb) GROUP BY ALL)"""
MMDP = f"""{D2}, bw AS (SELECT greatest(quantile_cont(d2, 0.5), 1e-12) AS m FROM pr WHERE i < j),
  mm AS (SELECT pa, pb, avg(CASE WHEN ba = pa AND bb = pa THEN exp(-d2 / (2 * m)) END) + avg(CASE WHEN ba = pb AND bb = pb THEN exp(-d2 / (2 * m)) END)
     - 2 * avg(CASE WHEN ba = pa AND bb = pb THEN exp(-d2 / (2 * m)) END) AS mmd2 FROM cp, bw JOIN pr ON ba IN (pa, pb) AND bb IN (pa, pb) GROUP BY ALL)"""


@query("M17_mmd2_per_context_pair", f"WITH {MMD} SELECT pa AS ctx_a, pb AS ctx_b, {rd('m')} AS bandwidth_sq, {rd('mmd2')} AS mmd2 FROM mm")
def m17(spark, d):
    out = K.mmd2_pairs(roles.cell_embeddings(spark, d), "batch", "cell_id", "emb")
    return out.select("ctx_a", "ctx_b", r("bandwidth_sq", "bandwidth_sq"), r("mmd2", "mmd2"))


@query("M18_mean_mmd2", f"WITH {MMD} SELECT {rd('avg(mmd2)')} AS mean_mmd2, count(*) AS n_pairs FROM mm")
def m18(spark, d):
    return K.mean_mmd2(roles.cell_embeddings(spark, d), "batch", "cell_id", "emb").select(r("mean_mmd2", "mean_mmd2"), "n_pairs")


@query("M18_mean_mmd2_pooled_bandwidth", f"WITH {MMDP} SELECT {rd('avg(mmd2)')} AS mean_mmd2, count(*) AS n_pairs FROM mm")
def m18p(spark, d):
    return K.mean_mmd2(roles.cell_embeddings(spark, d), "batch", "cell_id", "emb", "pooled").select(r("mean_mmd2", "mean_mmd2"), "n_pairs")


@query("M16_rbf_cka", f"""WITH {EMB}, pr AS (SELECT a.batch, a.cell_id AS i, b.cell_id AS j, sum(CASE WHEN a.d <= 32 THEN (a.x - b.x) * (a.x - b.x) ELSE 0 END) AS dx,
     sum(CASE WHEN a.d > 32 THEN (a.x - b.x) * (a.x - b.x) ELSE 0 END) AS dy FROM embl a JOIN embl b ON a.d = b.d AND a.batch = b.batch GROUP BY ALL),
  bw AS (SELECT batch, quantile_cont(dx, 0.5) AS mx, quantile_cont(dy, 0.5) AS my FROM pr WHERE i < j GROUP BY 1),
  kl AS (SELECT batch, i, j, exp(-dx / (2 * mx)) AS k, exp(-dy / (2 * my)) AS l FROM pr JOIN bw USING (batch)),
  ce AS (SELECT batch, k - avg(k) OVER (PARTITION BY batch, i) - avg(k) OVER (PARTITION BY batch, j) + avg(k) OVER (PARTITION BY batch) AS k,
     l - avg(l) OVER (PARTITION BY batch, i) - avg(l) OVER (PARTITION BY batch, j) + avg(l) OVER (PARTITION BY batch) AS l FROM kl)
  SELECT batch, {rd('sum(k * l) / sqrt(sum(k * k) * sum(l * l))')} AS rbf_cka FROM ce GROUP BY 1""")
def m16(spark, d):
    e = roles.cell_embeddings(spark, d).select("batch", "cell_id", F.slice("emb", 1, 32).alias("x"), F.slice("emb", 33, 32).alias("z"))
    return K.rbf_cka(e, "batch", "cell_id", "x", "z").select("batch", r("rbf_cka", "rbf_cka"))


SOFT = f"""{EMB}, pv AS (SELECT batch, construct, cell_id, sum(x) AS p FROM embl GROUP BY ALL),
  ps AS (SELECT *, row_number() OVER (PARTITION BY batch, construct ORDER BY cell_id) AS i FROM pv),
  mp AS (SELECT a.batch AS ca, b.batch AS cb, a.cell_id AS row_a, a.p AS a, b.p AS b FROM ps a JOIN ps b USING (construct, i) WHERE a.batch < b.batch),
  sr AS (SELECT x.ca, x.cb, x.row_a, sum(1 / (1 + exp(-(x.a - z.a) / 0.1))) AS sa, sum(1 / (1 + exp(-(x.b - z.b) / 0.1))) AS sb FROM mp x JOIN mp z ON x.ca = z.ca AND x.cb = z.cb AND x.row_a <> z.row_a GROUP BY ALL),
  sc AS (SELECT ca, cb, {pear('sa', 'sb')} AS rho FROM sr GROUP BY ALL)"""


def soft_loss(spark, d):
    e = roles.cell_embeddings(spark, d).withColumn("p", V.vsum("emb")).withColumn("sid", F.col("cell_id"))
    pairs = P.tier2(e, "batch", "cell_id", "construct", P.covered(P.tier1(e, "batch", "cell_id", "sid")))
    return P_soft(P.matched_values(pairs, e, "cell_id", "p"))


def P_soft(values, tau=0.1):
    """One minus the soft rank correlation per context pair, and the weighted mean over pairs."""
    v = values.select(F.concat_ws("|", "ctx_a", "ctx_b", "tier").alias("grp"), "row_a", "a", "b", "weight", "ctx_a", "ctx_b")
    soft = K.soft_ranks(v, "grp", "row_a", ["a", "b"], tau)
    n = F.count("*")
    den = F.sqrt(F.var_pop("soft_a") * n * F.var_pop("soft_b") * n)
    per = soft.groupBy("grp").agg(F.when(den < 1e-12, 0.0).otherwise(F.try_divide(F.covar_pop("soft_a", "soft_b") * n, den)).alias("rho"))
    w = v.groupBy("grp").agg(F.max("weight").alias("w"))
    return per.join(w, "grp").agg(
        F.coalesce(F.try_divide(F.sum(F.col("w") * (1 - F.col("rho"))), F.sum("w")), F.lit(0.0)).alias("loss"), F.count("*").alias("n_pairs"))


@query("M19_soft_spearman_loss", f"WITH {SOFT} SELECT {rd('avg(1 - rho)')} AS loss, count(*) AS n_pairs FROM sc")
def m19(spark, d):
    return soft_loss(spark, d).select(r("loss", "loss"), "n_pairs")
