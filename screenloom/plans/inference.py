"""Controls, resampling and intervals."""
from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.functions import stats as S, vector as V
from screenloom.operators import controls as C, features as X, normalize as N, pseudobulk as P, resample as B
from screenloom.plans.build import KEYS, MAG, Screen, magnitude_rows
from screenloom.plans.registry import query, r
from screenloom.plans.scoring import R2
from screenloom.plans.sqltext import CELLS, COUNTS, EMB, NCTRL, CTRL, NORM, SCORES, SCREEN, SIZES, boot_draws, digest, normal, rd
from screenloom.session import durable
from screenloom.sources import roles

SPLITOF = "CASE WHEN cell_id % 10 < 6 THEN 'train' WHEN cell_id % 10 < 8 THEN 'val' ELSE 'test' END"
SEEDED = "({s} + CASE WHEN cell_id % 10 < 6 THEN 0 WHEN cell_id % 10 < 8 THEN 1 ELSE 2 END)"


def emb_rows(spark, d):
    e = roles.cell_embeddings(spark, d)
    m = F.col("cell_id") % 10
    return e.withColumn("split", F.when(m < 6, "train").when(m < 8, "val").otherwise("test"))


def nsql(seed):
    s = SEEDED.format(s=seed)
    return normal(s, "cell_id", "i")


@query("C1_noise_features", f"""WITH n AS (SELECT cell_id, i, {nsql(20270101)} AS x FROM (SELECT o_orderkey AS cell_id FROM orders), (SELECT unnest(range(1, 9)) AS i))
  SELECT cell_id, {rd('sum(x)')} AS total, {rd('sqrt(sum(x * x))')} AS norm FROM n GROUP BY 1""")
def c1(spark, d):
    c = roles.cells(spark, d).select("cell_id", "split").withColumn("x", C.noise("cell_id", 8, C.SEEDS["C1"]))
    return c.select("cell_id", r(V.vsum("x"), "total"), r(V.norm("x"), "norm"))


@query("C2_fixed_projection", f"""WITH {EMB}, rm AS (SELECT i, j, {normal(20270102, 'i', 'j')} / sqrt(16.0) AS r FROM (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 17)) AS j)),
  p AS (SELECT cell_id, j, sum(x * r) AS x FROM embl JOIN rm ON d = i GROUP BY ALL)
  SELECT cell_id, {rd('sum(x)')} AS total, {rd('sqrt(sum(x * x))')} AS norm, {rd('max(x)')} AS hi FROM p GROUP BY 1""")
def c2(spark, d):
    p = C.project(roles.cell_embeddings(spark, d), "emb", C.projection_matrix(spark, 64, 16), "p")
    return p.select("cell_id", r(V.vsum("p"), "total"), r(V.norm("p"), "norm"), r(F.array_max("p"), "hi"))


def permsql(seed, src):
    return f"""pl AS (SELECT cell_id, split, row_number() OVER (PARTITION BY split ORDER BY cell_id) AS p FROM {src}),
  so AS (SELECT cell_id AS donor, split, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', {SEEDED.format(s=seed)}, cell_id))) AS p FROM {src}),
  perm AS (SELECT cell_id, donor FROM pl JOIN so USING (split, p))"""


@query("C3_row_shuffle", f"WITH {CELLS}, {permsql(20270103, 'cells')} SELECT cell_id, donor FROM perm")
def c3(spark, d):
    c = roles.cells(spark, d).select("split", "cell_id").withColumn("donor", F.col("cell_id"))
    return C.shuffled(c, "cell_id", ["donor"], C.SEEDS["C3"]).select("cell_id", "donor")


@query("C4_append_shuffled_block", f"""WITH {EMB}, e2 AS (SELECT cell_id, {SPLITOF} AS split FROM emb), {permsql(20270104, 'e2')},
  m AS (SELECT cell_id, avg(abs(x)) AS a, sqrt(sum(x * x)) AS b, max(abs(x)) AS c, stddev_pop(x) AS s, sum(x) AS t FROM embl GROUP BY 1)
  SELECT perm.cell_id, {rd('z.t + q.a + q.b + q.c + q.s')} AS total, CAST(68 AS INTEGER) AS width, {rd('q.b')} AS borrowed_l2
  FROM perm JOIN m z ON z.cell_id = perm.cell_id JOIN m q ON q.cell_id = donor""")
def c4(spark, d):
    e = emb_rows(spark, d)
    m = e.select("cell_id", "split", F.array(*V.magnitude("emb")).alias("m"))
    sh = C.shuffled(m, "cell_id", ["m"], C.SEEDS["C4"]).select("cell_id", "m")
    return e.join(sh, "cell_id").select("cell_id", F.concat("emb", "m").alias("x"), F.col("m")[1].alias("b")).select(
        "cell_id", r(V.vsum("x"), "total"), F.size("x").alias("width"), r("b", "borrowed_l2"))


@query("C5_append_noise_block", f"""WITH {EMB}, n AS (SELECT cell_id, sum({nsql(20270105)}) AS g FROM (SELECT cell_id FROM emb), (SELECT unnest(range(1, 5)) AS i) GROUP BY 1)
  SELECT cell_id, {rd('any_value(g) + sum(x)')} AS total, CAST(68 AS INTEGER) AS width FROM embl JOIN n USING (cell_id) GROUP BY 1""")
def c5(spark, d):
    e = emb_rows(spark, d).withColumn("x", F.concat("emb", C.noise("cell_id", 4, C.SEEDS["C5"])))
    return e.select("cell_id", r(V.vsum("x"), "total"), F.size("x").alias("width"))


REPS = 10_000

B1SQL = f"""{SCORES}, ix AS (SELECT *, row_number() OVER (ORDER BY row_key) - 1 AS i FROM scores),
  dr AS {boot_draws(42, REPS, "(SELECT count(*) AS n FROM scores)")},
  d AS (SELECT rep, ({R2.format(p='pred_a')}) - ({R2.format(p='pred_b')}) AS delta FROM dr JOIN ix ON hit = i GROUP BY rep)"""
SUMM = f"""SELECT {rd('quantile_cont(delta, 0.5)')} AS median, {rd('quantile_cont(delta, 0.025)')} AS ci_lo, {rd('quantile_cont(delta, 0.975)')} AS ci_hi,
  {rd('greatest(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END))')} AS sign_stab, count(delta) AS n,
  count(*) - count(delta) AS n_skipped"""


def _summary(s):
    return s.select(*[r(c, c) for c in ("median", "ci_lo", "ci_hi", "sign_stab")], "n", "n_skipped")


@query("B1_paired_row_bootstrap", f"WITH {B1SQL} {SUMM} FROM d")
def b1(spark, d):
    boot = B.row_bootstrap_delta_r2(roles.scores(spark, d), "row_key", "y", ["pred_a"], ["pred_b"], reps=REPS)
    return _summary(B.summarize(boot))


B2SQL = f"""{SCORES}, ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS c FROM (SELECT DISTINCT cluster FROM scores)),
  dr AS {boot_draws(20260901, REPS, "(SELECT count(DISTINCT cluster) AS n FROM scores)")},
  w AS (SELECT rep, hit, count(*) AS w FROM dr GROUP BY ALL),
  bo AS (SELECT rep, w, y, pred_a, pred_b FROM w JOIN ids ON hit = c JOIN scores USING (cluster)),
  rk AS (SELECT rep, w, {', '.join(f"sum(w) OVER (PARTITION BY rep ORDER BY {c}) - (sum(w) OVER (PARTITION BY rep ORDER BY {c} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 AS r_{c}" for c in ('y', 'pred_a', 'pred_b'))} FROM bo),
  rh AS (SELECT rep, {', '.join(f"(sum(w * r_y * r_{c}) - sum(w * r_y) * sum(w * r_{c}) / sum(w)) / sqrt((sum(w * r_y * r_y) - sum(w * r_y) * sum(w * r_y) / sum(w)) * (sum(w * r_{c} * r_{c}) - sum(w * r_{c}) * sum(w * r_{c}) / sum(w))) AS rho_{c}" for c in ('pred_a', 'pred_b'))} FROM rk GROUP BY rep),
  d AS (SELECT rho_pred_a - rho_pred_b AS delta FROM rh)"""


@query("B2_paired_cluster_bootstrap", f"WITH {B2SQL} {SUMM} FROM d")
def b2(spark, d):
    boot = B.cluster_bootstrap_rho(roles.scores(spark, d), "cluster", "y", {"a": ["pred_a"], "b": ["pred_b"]}, reps=REPS, key="row_key")
    return _summary(B.contrast(boot, "a", "b"))


B3SQL = f"""{SCORES}, ix AS (SELECT *, row_number() OVER (PARTITION BY row_key % 2 ORDER BY row_key) - 1 AS i, row_key % 2 AS screen FROM scores),
  dr AS {boot_draws(42, REPS, "(SELECT row_key % 2 AS screen, count(*) AS n FROM scores GROUP BY 1)")},
  d AS (SELECT screen, rep, ({R2.format(p='pred_a')}) - ({R2.format(p='pred_b')}) AS delta FROM dr JOIN ix USING (screen) WHERE hit = i GROUP BY screen, rep),
  s AS (SELECT screen, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM d GROUP BY 1),
  v AS (SELECT screen, CASE WHEN lo > 0 THEN 'resolved-positive' WHEN hi < 0 THEN 'resolved-negative' ELSE 'unresolved' END AS verdict FROM s)"""


@query("B3_interval_verdict", f"WITH {B3SQL} SELECT count(DISTINCT screen) AS n_screens, bool_and(verdict = 'resolved-positive') AS positive_in_all, bool_and(verdict = 'resolved-negative') AS negative_in_all FROM v")
def b3(spark, d):
    s = roles.scores(spark, d)
    out = None
    for i in (0, 1):
        boot = B.row_bootstrap_delta_r2(s.where(F.col("row_key") % 2 == i), "row_key", "y", ["pred_a"], ["pred_b"], reps=REPS)
        one = B.verdict(B.summarize(boot)).withColumn("screen", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return B.resolved_everywhere(out, [])


B4SQL = f"""{SCREEN}, {NCTRL}, {CTRL}, sd AS (SELECT unnest([20270201, 20270202, 20270203]) AS seed),
  pk AS (SELECT split, batch, target, seed, cell_id, row_number() OVER (PARTITION BY split, batch, target, seed ORDER BY md5(concat_ws('|', seed, cell_id)), cell_id) AS rn,
         count(*) OVER (PARTITION BY split, batch, target, seed) AS k FROM cells, sd WHERE target <> 'T0'),
  m AS (SELECT * FROM pk WHERE rn <= 10 AND k >= 10), grp AS (SELECT DISTINCT split, batch, target, seed FROM m),
  pr AS (SELECT split, batch, target, seed, gene_idx, sum(v) / 10.0 AS mean FROM m JOIN norm USING (cell_id) GROUP BY ALL),
  dn AS (SELECT g.split, g.batch, g.target, g.seed, coalesce(p.mean, 0) - coalesce(c.mean, 0) AS x FROM grp g CROSS JOIN (SELECT unnest(range(0, 64)) AS gene_idx) q
    LEFT JOIN pr p ON p.split = g.split AND p.batch = g.batch AND p.target = g.target AND p.seed = g.seed AND p.gene_idx = q.gene_idx
    LEFT JOIN ctrl c ON c.batch = g.batch AND c.gene_idx = q.gene_idx),
  mg AS (SELECT split, batch, target, seed, avg(abs(x)) AS mean_abs, sqrt(sum(x * x)) AS l2, max(abs(x)) AS max_abs, stddev_pop(x) AS sd FROM dn GROUP BY ALL)"""


@query("B4_depth_matched_magnitude", f"""WITH {B4SQL} SELECT split, seed, count(*) AS n_kept, {', '.join(f"{rd(f'quantile_cont({c}, 0.5)')} AS {c}" for c in MAG)} FROM mg GROUP BY ALL""")
def b4(spark, d):
    """Magnitudes rebuilt from ten cells per group and seed; controls are not subsampled."""
    s = Screen(spark, d)
    keys = [*KEYS, "seed"]
    picked = B.matched_cells(s.treated, KEYS, 10, [20270201, 20270202, 20270203])
    sizes = N.group_sizes(picked, keys)
    prof = P.group_mean(s.norm, picked, sizes, keys)
    delta = durable(P.delta(prof, sizes, s.base, keys, ["batch"]))
    g, x = roles.N_GENES, F.col("delta")
    m = delta.groupBy(*keys).agg(
        (F.sum(F.abs(x)) / g).alias("mean_abs"), F.sqrt(F.sum(x * x)).alias("l2"), F.max(F.abs(x)).alias("max_abs"),
        F.sqrt(F.sum(x * x) / g - F.pow(F.sum(x) / g, F.lit(2))).alias("sd"))
    long = m.unpivot(["split", "seed"], MAG, "feature", "value")
    med = X.quantiles_by_rank(long, "value", [0.5], ["split", "seed", "feature"])
    n = m.groupBy("split", "seed").agg(F.count("*").alias("n_kept"))
    wide = med.groupBy("split", "seed").agg(*[
        r(F.max(F.when(F.col("feature") == c, F.col("edges")[0])), c) for c in MAG])
    return n.join(wide, ["split", "seed"])


@query("B4_depth_matched_embedding", f"""WITH {EMB}, sd AS (SELECT unnest([20270201, 20270202, 20270203]) AS seed),
  pk AS (SELECT construct, seed, cell_id, row_number() OVER (PARTITION BY construct, seed ORDER BY md5(concat_ws('|', seed, cell_id)), cell_id) AS rn,
         count(*) OVER (PARTITION BY construct, seed) AS k FROM emb, sd WHERE construct <> 'L0'),
  m AS (SELECT * FROM pk WHERE rn <= 27 AND k >= 27), c AS (SELECT d, avg(x) AS b FROM embl WHERE construct = 'L0' GROUP BY 1),
  g AS (SELECT m.construct, seed, d, avg(x) AS a FROM m JOIN embl USING (cell_id) GROUP BY ALL)
  SELECT construct, seed, {rd('sqrt(sum((a - b) * (a - b)))')} AS z_norm FROM g JOIN c USING (d) GROUP BY ALL""")
def b4z(spark, d):
    e = roles.cell_embeddings(spark, d)
    picked = B.matched_cells(e.where(F.col("construct") != "L0"), ["construct"], 27, [20270201, 20270202, 20270203])
    base = P.vector_mean(e.where(F.col("construct") == "L0"), []).select("mean").scalar()
    means = P.vector_mean(picked, ["construct", "seed"]).withColumn("base", base)
    return means.select("construct", "seed", r(V.norm(V.subtract("mean", "base")), "z_norm"))


@query("B5_retention_report", f"""WITH {CELLS}, s AS (SELECT split, batch, target, count(*) AS n_cells FROM cells WHERE target <> 'T0' GROUP BY ALL)
  SELECT split, count(*) AS n_groups, count(*) FILTER (n_cells >= 10) AS kept_10, count(*) FILTER (n_cells >= 27) AS kept_27,
    count(*) FILTER (n_cells < 10) AS dropped_10, count(*) FILTER (n_cells < 27) AS dropped_27, {rd('quantile_cont(n_cells, 0.25)')} AS q25,
    {rd('quantile_cont(n_cells, 0.5)')} AS median, {rd('quantile_cont(n_cells, 0.75)')} AS q75 FROM s GROUP BY 1""")
def b5(spark, d):
    s = Screen(spark, d, min_cells=1).sizes
    out = B.retention(s, "split", [10, 27])
    return out.select(*[c for c in out.columns if c not in ("q25", "median", "q75")], *[r(c, c) for c in ("q25", "median", "q75")])


@query("B5_common_band", f"""WITH {CELLS}, s AS (SELECT split, batch, target, count(*) AS n_cells FROM cells WHERE target <> 'T0' GROUP BY ALL),
  q AS (SELECT split, quantile_cont(n_cells, 0.25) AS a, quantile_cont(n_cells, 0.75) AS b FROM s GROUP BY 1), b AS (SELECT max(a) AS lo, min(b) AS hi FROM q)
  SELECT split, count(*) FILTER (n_cells BETWEEN lo AND hi) AS n_in_band, {rd('any_value(lo)')} AS lower, {rd('any_value(hi)')} AS upper, any_value(lo) < any_value(hi) AS adequate FROM s, b GROUP BY 1""")
def b5b(spark, d):
    out = B.common_band(Screen(spark, d, min_cells=1).sizes, "split")
    return out.select("split", "n_in_band", r("lower", "lower"), r("upper", "upper"), "adequate")


@query("B7_stratified_folds", f"""SELECT vec_id AS cell_id, CAST(ntile(5) OVER (PARTITION BY label ORDER BY {digest(7, 'vec_id')}) - 1 AS INTEGER) AS fold FROM embeddings""")
def b7(spark, d):
    e = roles.cell_embeddings(spark, d)
    return B.stratified_folds(e.select("cell_id", "construct"), "construct", "cell_id", 5, 7).select("cell_id", "fold")


@query("B8_context_batches", f"""WITH {SCORES}, o AS (SELECT row_key, context, row_number() OVER (PARTITION BY context ORDER BY {digest(9, 'row_key')}) - 1 AS p FROM scores),
  k AS (SELECT greatest(4, CAST(floor(64 / count(DISTINCT context)) AS BIGINT)) AS take FROM scores), s AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM scores GROUP BY context))
  SELECT row_key, CAST(floor(p / take) AS BIGINT) AS batch_no FROM o, k, s WHERE m - floor(p / take) * take >= 2""")
def b8(spark, d):
    s = roles.scores(spark, d).select("row_key", "context")
    return B.context_batches(s, "context", "row_key", 64, 9).select("row_key", "batch_no")
