"""Ranks, bins, selection, metrics, labels and depth diagnostics."""
from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.functions import stats as S
from screenloom.functions.ordered import GROUP_LIMIT, average_rank, largest_group
from screenloom.operators import endpoint as E, features as X, metrics as M
from screenloom.plans.build import KEYS, MAG, MAGROWS, Screen, magnitude_rows
from screenloom.plans.registry import query, r
from screenloom.plans.sqltext import CELLS, EMB, FULL, NCTRL, SCORES, SCREEN, SIZES, digest, rd
from screenloom.session import durable
from screenloom.sources import roles

PEAR = "CASE WHEN var_pop({a}) * var_pop({b}) > 0 THEN covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) END"


def pear(a, b):
    return PEAR.format(a=a, b=b)


R2 = "1 - sum((y - {p}) * (y - {p})) / nullif(var_pop(y) * count(y), 0)"


def avg_rank(v, part=""):
    p = f"PARTITION BY {part}" if part else ""
    pv = f"PARTITION BY {part}, {v}" if part else f"PARTITION BY {v}"
    return f"(rank() OVER ({p} ORDER BY {v}) + (count(*) OVER ({pv}) - 1) / 2.0)"


@query("W1_average_tie_rank", f"""WITH {SCORES} SELECT row_key, {avg_rank('pred_b', 'context')} AS rank_b,
  {avg_rank('cluster', 'context')} AS rank_cluster FROM scores""")
def w1(spark, d):
    s = roles.scores(spark, d).select("row_key", "context", "pred_b", "cluster")
    return average_rank(s, ["context"], {"rank_b": "pred_b", "rank_cluster": "cluster"}).select("row_key", "rank_b", "rank_cluster")


@query("W4_context_top_k", f"""WITH {SCORES}, o AS (
  SELECT context, row_key, row_number() OVER (PARTITION BY context ORDER BY pred_b DESC, row_key) AS pos FROM scores)
  SELECT context, row_key, pos FROM o WHERE pos <= 25""")
def w4(spark, d):
    from pyspark.sql import Window
    s = roles.scores(spark, d)
    w = Window.partitionBy("context").orderBy(F.desc("pred_b"), "row_key")
    return s.select("context", "row_key", F.row_number().over(w).cast("bigint").alias("pos")).where("pos <= 25")


@query("W5_ecdf_rank_vs_train", f"""WITH {SCORES}, t AS (SELECT y, count(*) AS c FROM scores WHERE row_key % 10 < 6 GROUP BY 1),
  u AS (SELECT y, sum(c) OVER (ORDER BY y) AS at FROM t), n AS (SELECT sum(c) AS n FROM t)
  SELECT row_key, {rd('greatest(1.0 / n, least(1.0, coalesce(u.at, 0) / n))')} AS ecdf
  FROM (SELECT * FROM scores) s ASOF LEFT JOIN u ON s.y >= u.y, n""")
def w5(spark, d):
    s = roles.scores(spark, d).select("row_key", "y")
    return M.ecdf(s, "y", F.col("row_key") % 10 < 6).select("row_key", r("ecdf", "ecdf"))


QEDGE = "e AS (SELECT quantile_cont(y, 0.2) e1, quantile_cont(y, 0.4) e2, quantile_cont(y, 0.6) e3, quantile_cont(y, 0.8) e4 FROM scores WHERE row_key % 10 < 6)"
QBIN = "(CASE WHEN y > e1 THEN 1 ELSE 0 END + CASE WHEN y > e2 THEN 1 ELSE 0 END + CASE WHEN y > e3 THEN 1 ELSE 0 END + CASE WHEN y > e4 THEN 1 ELSE 0 END)"
PROBS = [0.2, 0.4, 0.6, 0.8]


@query("W6_train_quantile_bins", f"""WITH {SCORES}, {QEDGE}
  SELECT CAST({QBIN} AS INTEGER) AS bin, count(*) AS n, {rd('min(y)')} AS lo, {rd('max(y)')} AS hi FROM scores, e GROUP BY 1""")
def w6(spark, d):
    s = roles.scores(spark, d)
    train = s.where(F.col("row_key") % 10 < 6)
    edges = X.quantiles_by_rank(train, "y", PROBS, []).scalar()
    return s.withColumn("edges", edges).groupBy(X.bin_index("y", F.col("edges")).alias("bin")).agg(F.count("*").alias("n"), r(F.min("y"), "lo"), r(F.max("y"), "hi"))


@query("A12_exact_percentiles", f"""WITH {SCORES} SELECT context, {rd('quantile_cont(y, 0.025)')} AS p025,
  {rd('quantile_cont(y, 0.5)')} AS p50, {rd('quantile_cont(y, 0.975)')} AS p975 FROM scores GROUP BY 1""")
def a12(spark, d):
    q = X.quantiles_by_rank(roles.scores(spark, d).select("context", "y"), "y", [0.025, 0.5, 0.975], ["context"])
    return q.select("context", *[r(F.col("edges")[i], n) for i, n in enumerate(("p025", "p50", "p975"))])


@query("W7_depth_quintile_strata", f"""WITH {CELLS}, {SIZES}, e AS (
  SELECT split, quantile_cont(n_cells, 0.2) e1, quantile_cont(n_cells, 0.4) e2, quantile_cont(n_cells, 0.6) e3,
         quantile_cont(n_cells, 0.8) e4 FROM sizes GROUP BY 1)
  SELECT split, CAST({QBIN.replace('y >', 'n_cells >')} AS INTEGER) AS stratum, count(*) AS n, min(n_cells) AS lo, max(n_cells) AS hi
  FROM sizes JOIN e USING (split) GROUP BY ALL""")
def w7(spark, d):
    s = Screen(spark, d).sizes
    st = s.join(X.quantile_edges(s, "n_cells", PROBS, ["split"]), "split")
    return st.groupBy("split", X.bin_index("n_cells", F.col("edges")).alias("stratum")).agg(
        F.count("*").alias("n"), F.min("n_cells").alias("lo"), F.max("n_cells").alias("hi"))


@query("W8_equal_width_bins", f"""WITH {SCORES}, e AS (SELECT min(y) lo, max(y) hi FROM scores WHERE row_key % 10 < 6)
  SELECT least(19, greatest(0, CAST(floor((y - lo) * 20 / (hi - lo)) AS INTEGER))) AS bin, count(*) AS n FROM scores, e GROUP BY 1""")
def w8(spark, d):
    s = roles.scores(spark, d).select("row_key", "y")
    ends = s.where(F.col("row_key") % 10 < 6).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    b = X.equal_width_bin(F.col("y"), ends.select("lo").scalar(), ends.select("hi").scalar(), 20)
    return s.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def val_rows(spark, d):
    s = roles.scores(spark, d).where(F.col("row_key") % 10 >= 6)
    arm = (F.col("cluster") % 4).cast("int").alias("arm")
    seed = (F.col("row_key") % 3).cast("int").alias("seed")
    long = s.select(
        arm, seed, "y", "pred_a", "pred_b", ((F.col("pred_a") + F.col("pred_b")) / 2).alias("blend"),
        F.lit(None).cast("double").alias("broken"),
    ).unpivot(["arm", "seed", "y"], ["pred_a", "pred_b", "blend", "broken"], "family", "yhat")
    return long.groupBy("arm", "family", "seed").agg(S.r2("y", "yhat").alias("r2"))


VALSQL = f"""{SCORES}, long AS (
  SELECT CAST(cluster % 4 AS INTEGER) AS arm, CAST(row_key % 3 AS INTEGER) AS seed, y, 'pred_a' AS family, pred_a AS p FROM scores WHERE row_key % 10 >= 6
  UNION ALL SELECT CAST(cluster % 4 AS INTEGER), CAST(row_key % 3 AS INTEGER), y, 'pred_b', pred_b FROM scores WHERE row_key % 10 >= 6
  UNION ALL SELECT CAST(cluster % 4 AS INTEGER), CAST(row_key % 3 AS INTEGER), y, 'blend', (pred_a + pred_b) / 2 FROM scores WHERE row_key % 10 >= 6
  UNION ALL SELECT CAST(cluster % 4 AS INTEGER), CAST(row_key % 3 AS INTEGER), y, 'broken', NULL FROM scores WHERE row_key % 10 >= 6),
  val AS (SELECT arm, family, seed, {R2.format(p='p')} AS r2 FROM long GROUP BY ALL),
  summ AS (SELECT arm, family, avg(r2) AS mean, stddev_samp(r2) AS sd, count(r2) AS n_seeds FROM val GROUP BY ALL)"""


@query("W12_model_ranking_margin", f"""WITH {VALSQL}, o AS (
  SELECT *, row_number() OVER (PARTITION BY arm ORDER BY mean DESC, family) AS rn FROM summ WHERE mean IS NOT NULL)
  SELECT a.arm, a.family AS selected, b.family AS runner_up, {rd('a.mean - b.mean')} AS margin, {rd('a.mean')} AS best_val_mean,
         {rd('a.sd')} AS seed_sd, a.mean - b.mean < a.sd AS margin_inside_seed_sd
  FROM o a LEFT JOIN o b ON a.arm = b.arm AND b.rn = 2 WHERE a.rn = 1""")
def w12(spark, d):
    summ = M.seed_summary(val_rows(spark, d), ["arm", "family"], "r2")
    t = M.selection_table(summ, "arm", "family", "mean", "sd")
    return t.select("arm", "selected", "runner_up", r("margin", "margin"), r("best_val_mean", "best_val_mean"),
                    r("seed_sd", "seed_sd"), "margin_inside_seed_sd")


@query("M6_seed_summary", f"WITH {VALSQL} SELECT arm, family, {rd('mean')} AS mean, {rd('sd')} AS sd, n_seeds FROM summ")
def m6(spark, d):
    t = M.seed_summary(val_rows(spark, d), ["arm", "family"], "r2")
    return t.select("arm", "family", r("mean", "mean"), r("sd", "sd"), "n_seeds")


GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]


@query("W13_alpha_selection", f"""WITH {SCORES},
  tr AS (SELECT context, avg(pred_b) mx, avg(y) my, var_pop(pred_b) * count(*) sxx, covar_pop(pred_b, y) * count(*) sxy
         FROM scores WHERE row_key % 10 < 6 GROUP BY 1),
  g AS (SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]) AS alpha),
  f AS (SELECT context, CAST(alpha AS DOUBLE) AS alpha, my - sxy / (sxx + alpha) * mx AS b0, sxy / (sxx + alpha) AS b1 FROM tr, g),
  v AS (SELECT context, alpha, round(1 - sum((y - b0 - b1 * pred_b) * (y - b0 - b1 * pred_b)) / (var_pop(y) * count(*)), 9) AS r2
        FROM scores JOIN f USING (context) WHERE row_key % 10 BETWEEN 6 AND 7 GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY r2 DESC, alpha DESC) AS rn,
         count(*) OVER (PARTITION BY context, r2) AS tied FROM v)
  SELECT context, alpha AS selected_alpha, {rd('r2')} AS selected_r2, CAST(7 AS BIGINT) AS n_finite, tied > 1 AS tie_applied, 'OK' AS status FROM o WHERE rn = 1""")
def w13(spark, d):
    """One-feature ridge: every alpha follows from one pass of training moments."""
    s = roles.scores(spark, d)
    n = F.count("*")
    tr = s.where(F.col("row_key") % 10 < 6).groupBy("context").agg(
        F.avg("pred_b").alias("mx"), F.avg("y").alias("my"), (F.var_pop("pred_b") * n).alias("sxx"),
        (F.covar_pop("pred_b", "y") * n).alias("sxy"))
    f = tr.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in GRID])))
    f = f.withColumn("b1", F.col("sxy") / (F.col("sxx") + F.col("alpha"))).withColumn("b0", F.col("my") - F.col("b1") * F.col("mx"))
    v = s.where((F.col("row_key") % 10).between(6, 7)).join(f.select("context", "alpha", "b0", "b1"), "context")
    v = v.withColumn("yhat", F.col("b0") + F.col("b1") * F.col("pred_b")).groupBy("context", "alpha").agg(
        F.round(S.r2("y", "yhat"), 9).alias("r2"))
    out = M.select_alpha(v, ["context"])
    return out.select("context", "selected_alpha", r("selected_r2", "selected_r2"), "n_finite", "tie_applied", "status")


@query("M1_r2", f"WITH {SCORES} SELECT context, {rd(R2.format(p='pred_a'))} AS r2_a, {rd(R2.format(p='pred_b'))} AS r2_b FROM scores GROUP BY 1")
def m1(spark, d):
    return roles.scores(spark, d).groupBy("context").agg(r(S.r2("y", "pred_a"), "r2_a"), r(S.r2("y", "pred_b"), "r2_b"))


@query("M2_pearson", f"WITH {SCORES} SELECT context, {rd(pear('y', 'pred_a'))} AS r_a, {rd(pear('y', 'pred_b'))} AS r_b FROM scores GROUP BY 1")
def m2(spark, d):
    return roles.scores(spark, d).groupBy("context").agg(r(S.pearson("y", "pred_a"), "r_a"), r(S.pearson("y", "pred_b"), "r_b"))


RANKED = f"""{SCORES}, rk AS (SELECT *, {avg_rank('y', 'context')} AS ry, {avg_rank('pred_a', 'context')} AS ra, {avg_rank('pred_b', 'context')} AS rb FROM scores)"""


@query("M3_spearman", f"WITH {RANKED} SELECT context, {rd(pear('ry', 'ra'))} AS rho_a, {rd(pear('ry', 'rb'))} AS rho_b FROM rk GROUP BY 1")
def m3(spark, d):
    out = M.spearman(roles.scores(spark, d), ["context"], {"rho_a": ("y", "pred_a"), "rho_b": ("y", "pred_b")})
    return out.select("context", r("rho_a", "rho_a"), r("rho_b", "rho_b"))


def ndcg_sql(p, k):
    return f"""nd AS (SELECT context, y + greatest(0, -min(y) OVER (PARTITION BY context)) AS g, {k} AS k,
    row_number() OVER (PARTITION BY context ORDER BY {p} DESC, row_key) AS i,
    row_number() OVER (PARTITION BY context ORDER BY y DESC, row_key) AS j FROM
    (SELECT *, count(*) OVER (PARTITION BY context) AS n FROM scores)),
  ndcg AS (SELECT context, sum(CASE WHEN i <= k THEN g / log2(i + 1) END) / nullif(sum(CASE WHEN j <= k THEN g / log2(j + 1) END), 0) AS ndcg
    FROM nd GROUP BY 1)"""


@query("M4_ndcg_at_fraction", f"WITH {SCORES}, {ndcg_sql('pred_b', 'greatest(1, round_even(0.1 * n, 0))')} SELECT context, {rd('ndcg')} AS ndcg FROM ndcg")
def m4(spark, d):
    return M.ndcg(roles.scores(spark, d), ["context"], "y", "pred_b", "row_key", 0.1).select("context", r("ndcg", "ndcg"))


@query("M4_ndcg_at_k", f"WITH {SCORES}, {ndcg_sql('pred_a', 'least(50, n)')} SELECT context, {rd('ndcg')} AS ndcg FROM ndcg")
def m4k(spark, d):
    return M.ndcg(roles.scores(spark, d), ["context"], "y", "pred_a", "row_key", 50).select("context", r("ndcg", "ndcg"))


@query("M5_predictive_bundle", f"""WITH {RANKED}, {ndcg_sql('pred_b', 'greatest(1, round_even(0.1 * n, 0))')},
  m AS (SELECT context, count(*) AS n, {R2.format(p='pred_b')} AS r2, {pear('y', 'pred_b')} AS pearson, {pear('ry', 'rb')} AS spearman FROM rk GROUP BY 1)
  SELECT context, n, {rd('r2')} AS r2, {rd('pearson')} AS pearson, {rd('spearman')} AS spearman, {rd('ndcg')} AS ndcg FROM m JOIN ndcg USING (context)""")
def m5(spark, d):
    b = M.predictive_bundle(roles.scores(spark, d), ["context"], "y", "pred_b", "row_key")
    return b.select("context", "n", *[r(c, c) for c in ("r2", "pearson", "spearman", "ndcg")])


@query("A14_mse_weighted", f"""WITH {SCORES} SELECT context, {rd('avg((y - pred_b) * (y - pred_b))')} AS mse,
  {rd('sum((cluster % 3) * (y - pred_b) * (y - pred_b)) / sum(cluster % 3)')} AS wmse,
  {rd('avg((y - pred_b) * (y - pred_b))')} AS zero_weight_mse FROM scores GROUP BY 1""")
def a14(spark, d):
    return roles.scores(spark, d).groupBy("context").agg(
        r(S.mse("y", "pred_b"), "mse"), r(S.weighted_mse("y", "pred_b", F.col("cluster") % 3), "wmse"),
        r(S.weighted_mse("y", "pred_b", F.lit(0)), "zero_weight_mse"))


ADSQL = f"""{FULL},
  own AS (SELECT s.*, CAST(substr(target, 2) AS INTEGER) AS gene_idx FROM sizes s),
  val1 AS (SELECT o.split, o.batch, o.target, coalesce(n.v, 0) AS v FROM own o JOIN cells c USING (split, batch, target)
           LEFT JOIN norm n ON n.cell_id = c.cell_id AND n.gene_idx = o.gene_idx),
  val2 AS (SELECT o.split, o.batch, o.target, coalesce(n.v, 0) AS v FROM own o JOIN cells c ON c.batch = o.batch AND c.target = 'T0'
           LEFT JOIN norm n ON n.cell_id = c.cell_id AND n.gene_idx = o.gene_idx),
  hist AS (SELECT split, batch, target, v, sum(a) AS f1, sum(b) AS f2 FROM (
      SELECT *, 1 AS a, 0 AS b FROM val1 UNION ALL SELECT *, 0, 1 FROM val2) GROUP BY ALL),
  cum AS (SELECT *, f1 + f2 AS l, sum(f1) OVER w - f1 / 2.0 AS m1, sum(f1 + f2) OVER w - (f1 + f2) / 2.0 AS bj,
      sum(f1) OVER p AS n1, sum(f1 + f2) OVER p AS n FROM hist
      WINDOW w AS (PARTITION BY split, batch, target ORDER BY v), p AS (PARTITION BY split, batch, target)),
  a2 AS (SELECT split, batch, target, any_value(n1) AS n1, any_value(n) AS n,
      (any_value(n) - 1.0) / any_value(n) * (1.0 / any_value(n1) + 1.0 / (any_value(n) - any_value(n1)))
        * sum(l / n * (n * m1 - n1 * bj) * (n * m1 - n1 * bj) / nullif(bj * (n - bj) - n * l / 4.0, 0)) AS a2 FROM cum GROUP BY ALL),
  ns AS (SELECT DISTINCT n FROM a2),
  hh AS (SELECT n, (SELECT sum(1.0 / i) FROM range(1, CAST(n AS BIGINT)) t(i)) AS h FROM ns),
  ii AS (SELECT n, unnest(range(1, CAST(n AS BIGINT))) AS i FROM ns),
  hc AS (SELECT n, i, sum(1.0 / i) OVER (PARTITION BY n ORDER BY i) AS hi FROM ii),
  gg AS (SELECT a.n, sum((h.h - b.hi) / a.i) AS g FROM hc a JOIN hc b ON a.n = b.n AND b.i = a.n - a.i JOIN hh h ON h.n = a.n WHERE a.i >= 2 GROUP BY a.n),
  co AS (SELECT a.*, h, g, 1.0 / n1 + 1.0 / (a.n - n1) AS hs FROM a2 a JOIN hh USING (n) JOIN gg USING (n)),
  st AS (SELECT *, (4 * g - 6) + (10 - 6 * g) * hs AS ca, (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * hs - 8 * h + 4 * g - 6 AS cb,
      (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * hs + 4 * h AS cc, (2 * h + 6) * 4 - 8 * h AS cd FROM co),
  ad AS (SELECT split, batch, target, CAST(n1 AS BIGINT) AS n1, CAST(n - n1 AS BIGINT) AS n2,
      (a2 - 1) / sqrt((ca * n * n * n + cb * n * n + cc * n + cd) / ((n - 1.0) * (n - 2.0) * (n - 3.0))) AS stat FROM st),
  labels_y AS (SELECT *, ln(1 + greatest(0, stat)) AS y FROM ad WHERE stat IS NOT NULL)"""


def labels_of(s: Screen):
    return E.label_groups(s.norm, s.cells, s.sizes, roles.own_gene(), KEYS, roles.CONTROL)


@query("A6_anderson_darling_label", f"WITH {ADSQL} SELECT split, batch, target, n1, n2, {rd('stat')} AS stat, {rd('y')} AS y FROM labels_y")
def a6(spark, d):
    return labels_of(Screen(spark, d)).select(*KEYS, "n1", "n2", r("stat", "stat"), r("y", "y"))


VC = ["ssb", "ssw", "total_ss", "msb", "msw", "m0", "var_between", "icc", "eta_squared", "de_arith", "de_weighted", "approx_n_arith", "approx_n_weighted"]


@query("A13_variance_components", f"""WITH {CELLS}, {SIZES}, rows AS (
    SELECT split, 'target' AS axis, target AS grp, ln(1 + n_cells) AS t FROM sizes UNION ALL SELECT split, 'batch', batch, ln(1 + n_cells) FROM sizes),
  g AS (SELECT split, axis, grp, count(*)::DOUBLE AS m, avg(t) AS mu, var_pop(t) AS v FROM rows GROUP BY ALL),
  t AS (SELECT split, axis, avg(t) AS tbar, var_pop(t) * count(*) AS total_ss FROM rows GROUP BY ALL),
  a AS (SELECT split, axis, sum(m) AS n, count(*)::DOUBLE AS k, sum(m * m) AS m2, min(m) AS size_min, max(m) AS size_max, quantile_cont(m, 0.5) AS size_median,
        sum(m * (mu - tbar) * (mu - tbar)) AS ssb, sum(v * m) AS ssw, any_value(total_ss) AS total_ss FROM g JOIN t USING (split, axis) GROUP BY ALL),
  b AS (SELECT *, ssb / nullif(k - 1, 0) AS msb, ssw / nullif(n - k, 0) AS msw, (n - m2 / n) / nullif(k - 1, 0) AS m0 FROM a),
  c AS (SELECT *, (msb - msw) / m0 AS var_between FROM b), e AS (SELECT *, var_between / (var_between + msw) AS icc, ssb / total_ss AS eta_squared FROM c),
  f AS (SELECT *, 1 + (n / k - 1) * icc AS de_arith, 1 + (m2 / n - 1) * icc AS de_weighted FROM e),
  h AS (SELECT *, CASE WHEN de_arith > 0 THEN n / de_arith END AS approx_n_arith, CASE WHEN de_weighted > 0 THEN n / de_weighted END AS approx_n_weighted FROM f)
  SELECT split, axis, n, k, size_min, size_max, size_median, {', '.join(f"{rd(c)} AS {c}" for c in VC)},
         coalesce(de_arith > 0, false) AS interpretable_arith, coalesce(de_weighted > 0, false) AS interpretable_weighted FROM h""")
def a13(spark, d):
    t = Screen(spark, d).sizes.withColumn("t", F.log1p("n_cells"))
    v = E.variance_components(t, "t", ["target", "batch"], ["split"])
    return v.select("split", "axis", "n", "k", "size_min", "size_max", "size_median", *[r(c, c) for c in VC],
                    "interpretable_arith", "interpretable_weighted")


def labelled(spark, d):
    """Magnitude scalars, cell count and label per group."""
    s = Screen(spark, d)
    s.norm = durable(s.norm)  # read by the sums and by the histograms
    return magnitude_rows(s).join(labels_of(s).select(*KEYS, "y"), KEYS).withColumn("log_n", F.log1p("n_cells"))


LABELLED = ADSQL + MAGROWS[len(FULL):] + """, lab AS (SELECT mag.*, y, ln(1 + n_cells) AS log_n FROM mag JOIN labels_y USING (split, batch, target))"""


# feature values are compared after rounding so that ties agree whatever the order of summation
def rounded(df):
    return df.select(*KEYS, "n_cells", "log_n", F.round("y", 9).alias("y"), *[F.round(c, 9).alias(c) for c in MAG])


RLAB = "rl AS (SELECT split, batch, target, n_cells, log_n, round(y, 9) AS y, " + ", ".join(f"round({c}, 9) AS {c}" for c in MAG) + " FROM lab)"


@query("M7_partial_rank_correlation", f"""WITH {LABELLED}, {RLAB}, k AS (SELECT split, {avg_rank('y', 'split')} AS ry, {avg_rank('log_n', 'split')} AS rz,
    {', '.join(avg_rank(c, 'split') + f' AS r_{c}' for c in MAG)} FROM rl),
  c AS ({' UNION ALL '.join(f"SELECT split, '{c}' AS feature, {pear(f'r_{c}', 'ry')} AS xy, {pear(f'r_{c}', 'rz')} AS xz, {pear('ry', 'rz')} AS yz FROM k GROUP BY split" for c in MAG)})
  SELECT split, feature, {rd('xy')} AS pooled, {rd('xz')} AS with_control, {rd('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} AS partial FROM c""")
def m7(spark, d):
    p = M.partial_rank_correlation(
        rounded(labelled(spark, d)), ["split"], MAG, "y", "log_n", bound=Screen(spark, d).sizes)
    return p.select("split", "feature", r("pooled", "pooled"), r("with_control", "with_control"), r("partial", "partial"))


@query("M8_stratified_correlation", f"""WITH {LABELLED}, {RLAB}, e AS (
    SELECT split, quantile_cont(n_cells, 0.2) e1, quantile_cont(n_cells, 0.4) e2, quantile_cont(n_cells, 0.6) e3, quantile_cont(n_cells, 0.8) e4 FROM rl GROUP BY 1),
  s AS (SELECT rl.*, CAST({QBIN.replace('y >', 'n_cells >')} AS INTEGER) AS stratum FROM rl JOIN e USING (split)),
  l AS ({' UNION ALL '.join(f"SELECT split, stratum, '{c}' AS feature, {c} AS v, y FROM s" for c in MAG)}),
  k AS (SELECT split, stratum, feature, {avg_rank('v', 'split, stratum, feature')} AS rv, {avg_rank('y', 'split, stratum, feature')} AS ry FROM l)
  SELECT split, stratum, feature, count(*) AS n, {rd(pear('rv', 'ry'))} AS rho FROM k GROUP BY ALL""")
def m8(spark, d):
    t = durable(rounded(labelled(spark, d)))
    t = t.join(X.quantile_edges(t, "n_cells", PROBS, ["split"]), "split").withColumn("stratum", X.bin_index("n_cells", F.col("edges")))
    long = t.select("split", "stratum", "y", *MAG).unpivot(["split", "stratum", "y"], MAG, "feature", "v")
    keys = ["split", "stratum", "feature"]
    # a stratum of one feature holds no more rows than its split has groups
    fits_one_task = largest_group(Screen(spark, d).sizes, ["split"]) <= GROUP_LIMIT
    ranked = average_rank(long, keys, {"rv": "v", "ry": "y"}, None if fits_one_task else 0)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), r(S.pearson("rv", "ry"), "rho"))


@query("M23_tail_weights", f"""WITH {SCORES}, {QEDGE}, t AS (SELECT y, count(*) AS c FROM scores WHERE row_key % 10 < 6 GROUP BY 1),
  u AS (SELECT y, sum(c) OVER (ORDER BY y) AS at FROM t), n AS (SELECT sum(c) AS n FROM t),
  w AS (SELECT s.context, s.y, s.pred_b, 1 + abs(greatest(1.0 / n, least(1.0, coalesce(u.at, 0) / n)) - 0.5) AS wr
        FROM (SELECT * FROM scores WHERE row_key % 10 >= 6) s ASOF LEFT JOIN u ON s.y >= u.y, n),
  q AS (SELECT w.*, [2.0, 1.0, 1.0, 1.0, 2.0][{QBIN} + 1] AS wq FROM w, e)
  SELECT context, {rd('sum(wr * (y - pred_b) * (y - pred_b)) / sum(wr)')} AS rank_weighted_mse,
         {rd('sum(wq * (y - pred_b) * (y - pred_b)) / sum(wq)')} AS quintile_weighted_mse FROM q GROUP BY 1""")
def m23(spark, d):
    s = roles.scores(spark, d)
    train = F.col("row_key") % 10 < 6
    edges = X.quantiles_by_rank(s.where(train), "y", PROBS, []).scalar()
    t = M.ecdf(s, "y", train).where(~train)
    t = t.withColumn("edges", edges).withColumn("wr", M.rank_tail_weight())
    t = t.withColumn("wq", M.quintile_tail_weight(X.bin_index("y", F.col("edges"))))
    return t.groupBy("context").agg(
        r(S.weighted_mse("y", "pred_b", "wr"), "rank_weighted_mse"), r(S.weighted_mse("y", "pred_b", "wq"), "quintile_weighted_mse"))


@query("M24_label_density_weights", f"""WITH {SCORES}, tr AS (SELECT y FROM scores WHERE row_key % 10 < 6), e AS (SELECT min(y) lo, max(y) hi FROM tr),
  bins AS (SELECT unnest(range(0, 20)) AS bin),
  idx AS (SELECT (SELECT count(*) FROM range(1, 20) t(i) WHERE tr.y >= lo + i * ((hi - lo) / 20.0)) AS bin FROM tr, e),
  c AS (SELECT b.bin, count(i.bin) AS c FROM bins b LEFT JOIN idx i USING (bin) GROUP BY 1),
  kr AS (SELECT j, exp(-0.5 * (j / 2.0) * (j / 2.0)) AS w FROM range(-8, 9) t(j)), kn AS (SELECT j, w / (SELECT sum(w) FROM kr) AS w FROM kr),
  sm AS (SELECT b.bin, sum(kn.w * c.c) AS s FROM bins b, kn JOIN c ON c.bin = CASE WHEN b.bin + j < 0 THEN -1 - (b.bin + j) WHEN b.bin + j > 19 THEN 39 - (b.bin + j) ELSE b.bin + j END GROUP BY 1),
  w AS (SELECT bin, 1 / sqrt(s / (SELECT sum(s) FROM sm) + 1e-12) AS w FROM sm),
  m AS (SELECT sum(w.w * c.c) / sum(c.c) AS m FROM w JOIN c USING (bin))
  SELECT CAST(c.bin AS INTEGER) AS bin, {rd('lo + c.bin * ((hi - lo) / 20.0)')} AS left_edge, CAST(c AS DOUBLE) AS n_train, {rd('least(5.0, w / m)')} AS weight
  FROM c JOIN w USING (bin), m, e""")
def m24(spark, d):
    s = roles.scores(spark, d).where(F.col("row_key") % 10 < 6)
    return M.density_weights(s, "y").select("bin", r("left_edge", "left_edge"), "n_train", r("weight", "weight"))


@query("M24_density_weighted_error", f"""WITH {SCORES}, tr AS (SELECT y FROM scores WHERE row_key % 10 < 6), e AS (SELECT min(y) lo, max(y) hi FROM tr),
  bins AS (SELECT unnest(range(0, 20)) AS bin),
  idx AS (SELECT (SELECT count(*) FROM range(1, 20) t(i) WHERE tr.y >= lo + i * ((hi - lo) / 20.0)) AS bin FROM tr, e),
  c AS (SELECT b.bin, count(i.bin) AS c FROM bins b LEFT JOIN idx i USING (bin) GROUP BY 1),
  kr AS (SELECT j, exp(-0.5 * (j / 2.0) * (j / 2.0)) AS w FROM range(-8, 9) t(j)), kn AS (SELECT j, w / (SELECT sum(w) FROM kr) AS w FROM kr),
  sm AS (SELECT b.bin, sum(kn.w * c.c) AS s FROM bins b, kn JOIN c ON c.bin = CASE WHEN b.bin + j < 0 THEN -1 - (b.bin + j) WHEN b.bin + j > 19 THEN 39 - (b.bin + j) ELSE b.bin + j END GROUP BY 1),
  w AS (SELECT bin, 1 / sqrt(s / (SELECT sum(s) FROM sm) + 1e-12) AS w FROM sm),
  m AS (SELECT sum(w.w * c.c) / sum(c.c) AS m FROM w JOIN c USING (bin)),
  wt AS (SELECT c.bin, least(5.0, w / m) AS weight FROM c JOIN w USING (bin), m),
  sc AS (SELECT y, pred_b, (SELECT count(*) FROM range(1, 20) t(i) WHERE s.y > lo + i * ((hi - lo) / 20.0)) AS bin FROM scores s, e WHERE row_key % 10 >= 6)
  SELECT {rd('sum(weight * (pred_b - y) * (pred_b - y)) / sum(weight)')} AS weighted_mse, count(*) AS n FROM sc JOIN wt USING (bin)""")
def m24e(spark, d):
    s = roles.scores(spark, d)
    table = M.density_weights(s.where(F.col("row_key") % 10 < 6), "y")
    return M.density_weighted_error(s.where(F.col("row_key") % 10 >= 6), table, "y", "pred_b").select(r("weighted_mse", "weighted_mse"), "n")


@query("M25_bce_from_logits", f"""SELECT lang, {rd('avg(greatest(x, 0) - x * quality + ln(1 + exp(-abs(x))))')} AS bce FROM (
    SELECT lang, quality, ln(1 + n_chars) - 6 AS x FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def m25(spark, d):
    from screenloom.sources.tables import read
    j = read(spark, d, "labels", ["doc_id", "quality"]).join(read(spark, d, "documents", ["doc_id", "lang", "n_chars"]), "doc_id")
    j = j.withColumn("logit", F.log1p("n_chars") - 6)
    return j.groupBy("lang").agg(r(S.bce_with_logits("quality", "logit"), "bce"))


@query("M27_transfer_gap", f"""WITH {RANKED}, c AS (SELECT context, {R2.format(p='pred_b')} AS r2, {pear('ry', 'rb')} AS rho FROM rk GROUP BY 1),
  h AS (SELECT r2 AS hr, rho AS hs FROM c WHERE context = 1996), w AS (SELECT min(r2) AS w FROM c)
  SELECT context, {rd('hr - r2')} AS gap, {rd('(hr - r2) / abs(hr)')} AS gap_rel, {rd('hs - rho')} AS spearman_gap, {rd('w')} AS robustness_worst_ctx
  FROM c, h, w WHERE context <> 1996""")
def m27(spark, d):
    s = roles.scores(spark, d)
    ranked = average_rank(s, ["context"], {"ry": "y", "rb": "pred_b"})
    per = ranked.groupBy("context").agg(S.r2("y", "pred_b").alias("r2"), S.pearson("ry", "rb").alias("spearman"))
    g = M.transfer_gap(per, F.col("context") == 1996)
    return g.select("context", *[r(c, c) for c in ("gap", "gap_rel", "spearman_gap", "robustness_worst_ctx")])


def sized_sql(screen: str, n_treated: int, n_control: int, draws: int) -> str:
    return f"""{screen}, dr AS (SELECT CAST(unnest(range(1, {draws + 1})) AS INTEGER) AS draw),
  t0 AS (SELECT split, batch, target, cell_id, draw, row_number() OVER (PARTITION BY split, batch, target, draw ORDER BY {digest(20270201, 'draw', 'cell_id')}, cell_id) AS rn,
         count(*) OVER (PARTITION BY split, batch, target, draw) AS k FROM cells, dr WHERE target <> 'T0'),
  c0 AS (SELECT batch, cell_id, draw, row_number() OVER (PARTITION BY batch, draw ORDER BY {digest(20270201, 'draw', 'cell_id')}, cell_id) AS rn,
         count(*) OVER (PARTITION BY batch, draw) AS k FROM cells, dr WHERE target = 'T0'),
  t1 AS (SELECT * FROM t0 WHERE rn <= {n_treated} AND k >= {n_treated}), c1 AS (SELECT * FROM c0 WHERE rn <= {n_control} AND k >= {n_control}),
  grp AS (SELECT DISTINCT split, batch, target, draw, CAST(substr(target, 2) AS INTEGER) AS gene_idx FROM t1),
  hist AS (SELECT split, batch, target, draw, v, sum(a) AS f1, sum(b) AS f2 FROM (
     SELECT g.split, g.batch, g.target, g.draw, coalesce(n.v, 0) AS v, 1 AS a, 0 AS b FROM grp g JOIN t1 USING (split, batch, target, draw) LEFT JOIN norm n ON n.cell_id = t1.cell_id AND n.gene_idx = g.gene_idx
     UNION ALL SELECT g.split, g.batch, g.target, g.draw, coalesce(n.v, 0), 0, 1 FROM grp g JOIN c1 ON c1.batch = g.batch AND c1.draw = g.draw LEFT JOIN norm n ON n.cell_id = c1.cell_id AND n.gene_idx = g.gene_idx) GROUP BY ALL),
  cum AS (SELECT *, f1 + f2 AS l, sum(f1) OVER w - f1 / 2.0 AS m1, sum(f1 + f2) OVER w - (f1 + f2) / 2.0 AS bj,
      sum(f1) OVER p AS n1, sum(f1 + f2) OVER p AS n FROM hist
      WINDOW w AS (PARTITION BY split, batch, target, draw ORDER BY v), p AS (PARTITION BY split, batch, target, draw)),
  a2 AS (SELECT split, batch, target, draw, any_value(n1) AS n1, any_value(n) AS n,
      (any_value(n) - 1.0) / any_value(n) * (1.0 / any_value(n1) + 1.0 / (any_value(n) - any_value(n1)))
        * sum(l / n * (n * m1 - n1 * bj) * (n * m1 - n1 * bj) / nullif(bj * (n - bj) - n * l / 4.0, 0)) AS a2 FROM cum GROUP BY ALL),
  ns AS (SELECT DISTINCT n FROM a2 WHERE n > n1),
  hh AS (SELECT n, (SELECT sum(1.0 / i) FROM range(1, CAST(n AS BIGINT)) t(i)) AS h FROM ns),
  ii AS (SELECT n, unnest(range(1, CAST(n AS BIGINT))) AS i FROM ns),
  hc AS (SELECT n, i, sum(1.0 / i) OVER (PARTITION BY n ORDER BY i) AS hi FROM ii),
  gg AS (SELECT a.n, sum((h.h - b.hi) / a.i) AS g FROM hc a JOIN hc b ON a.n = b.n AND b.i = a.n - a.i JOIN hh h ON h.n = a.n WHERE a.i >= 2 GROUP BY a.n),
  co AS (SELECT a.*, h, g, 1.0 / n1 + 1.0 / (a.n - n1) AS hs FROM a2 a JOIN hh USING (n) JOIN gg USING (n)),
  st AS (SELECT *, (4 * g - 6) + (10 - 6 * g) * hs AS ca, (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * hs - 8 * h + 4 * g - 6 AS cb,
      (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * hs + 4 * h AS cc, (2 * h + 6) * 4 - 8 * h AS cd FROM co),
  ad AS (SELECT split, batch, target, draw, ln(1 + greatest(0, (a2 - 1) / sqrt((ca * n * n * n + cb * n * n + cc * n + cd) / ((n - 1.0) * (n - 2.0) * (n - 3.0))))) AS y
      FROM st WHERE a2 IS NOT NULL)"""


def sized_summary(screen: str, n_treated: int, n_control: int, draws: int) -> str:
    return f"""WITH {sized_sql(screen, n_treated, n_control, draws)} SELECT split, batch, target, {rd('avg(y)')} AS y_mean, {rd('stddev_samp(y)')} AS y_std,
  {rd('quantile_cont(y, 0.05)')} AS y_p5, {rd('quantile_cont(y, 0.95)')} AS y_p95, {rd('quantile_cont(y, 0.75) - quantile_cont(y, 0.25)')} AS y_iqr, count(y) AS n_valid
  FROM ad GROUP BY ALL"""


def sized_labels(s: Screen, n_treated: int, n_control: int, draws: int):
    lab = E.size_controlled_labels(s.norm, s.treated, s.controls, roles.own_gene(), KEYS, n_treated, n_control, draws, 20270201)
    out = E.summarize_draws(lab, KEYS)
    return out.select(*KEYS, *[r(c, c) for c in ("y_mean", "y_std", "y_p5", "y_p95", "y_iqr")], "n_valid")


@query("B6_size_controlled_endpoint", sized_summary(SCREEN, 12, 30, 5))
def b6(spark, d):
    return sized_labels(Screen(spark, d), 12, 30, 5)


#: One pool of controls for all batches and half as many targets, so that controls reach the published number.
POOLED = SCREEN.replace("CAST(year(o_orderdate) AS VARCHAR) AS batch", "'all' AS batch").replace("o_custkey % 32", "o_custkey % 16")


@query("B6_size_controlled_published", sized_summary(POOLED, 27, 788, 20))
def b6_published(spark, d):
    """The published sizes, 27 treated and 788 control cells, drawn 20 times."""
    s = Screen(spark, d)
    s.cells = roles.cells(spark, d, targets=16).withColumn("batch", F.lit("all"))
    return sized_labels(s, 27, 788, 20)

