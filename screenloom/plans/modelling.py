"""Cross-product statistics, linear fits, sweeps, probes and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.functions import stats as S, vector as V
from screenloom.operators import blocks as K, boosting, controls as C, features as X, linear as L, metrics as M
from screenloom.plans import evaluation as E
from screenloom.plans.build import KEYS, MAG, Screen, magnitude_rows
from screenloom.plans.inference import SPLITOF, emb_rows, nsql, permsql
from screenloom.plans.pairing import MMD, SOFT, soft_loss
from screenloom.plans.registry import ORACLES, query, r
from screenloom.plans.scoring import LABELLED, R2, avg_rank, labelled, pear, rounded
from screenloom.plans.sqltext import CELLS, EMB, SCORES, normal, rd, ridge_sql
from screenloom.sources import roles
from screenloom.session import durable

COV = f"""{EMB}, half AS (SELECT batch, cell_id, d, x FROM embl),
  c AS (SELECT a.batch, a.d AS i, b.d AS j, covar_samp(a.x, b.x) AS c, covar_pop(a.x, b.x) * count(*) AS s FROM half a JOIN half b USING (batch, cell_id) GROUP BY ALL)"""


@query("A15_cross_covariance_penalty", f"""WITH {COV} SELECT batch, {rd('sum(CASE WHEN i <= 32 AND j > 32 THEN c * c END) / (sqrt(sum(CASE WHEN i <= 32 AND j <= 32 THEN c * c END)) * sqrt(sum(CASE WHEN i > 32 AND j > 32 THEN c * c END)) + 1e-8)')} AS penalty FROM c GROUP BY 1""")
def a15(spark, d):
    g = L.gram(roles.cell_embeddings(spark, d), ["batch"], F.col("emb"))
    return L.covariance_penalty(g, ["batch"], 32, 64).select("batch", r("penalty", "penalty"))


@query("A16_gram", f"""WITH {EMB}, y AS (SELECT cell_id, CAST(substr(construct, 2) AS DOUBLE) AS y FROM emb),
  g AS (SELECT a.d - 1 AS i, b.d - 1 AS j, sum(a.x * b.x) AS s FROM embl a JOIN embl b USING (cell_id) GROUP BY ALL UNION ALL
        SELECT d - 1, 65, sum(x * y) FROM embl JOIN y USING (cell_id) GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {rd('s')} AS s FROM g""")
def a16(spark, d):
    e = roles.cell_embeddings(spark, d).withColumn("y", F.substring("construct", 2, 9).cast("double"))
    g = L.gram(e, [], F.col("emb"), ["y"])
    return g.where("i < 64 AND (j < 64 OR j = 65)").select("i", "j", r("s", "s"))


@query("M15_linear_cka", f"""WITH {COV} SELECT batch, {rd('sum(CASE WHEN i <= 32 AND j > 32 THEN s * s END) / (sqrt(sum(CASE WHEN i <= 32 AND j <= 32 THEN s * s END)) * sqrt(sum(CASE WHEN i > 32 AND j > 32 THEN s * s END)))')} AS linear_cka FROM c GROUP BY 1""")
def m15(spark, d):
    g = L.gram(roles.cell_embeddings(spark, d), ["batch"], F.col("emb"))
    return L.linear_cka(g, ["batch"], 32, 64).select("batch", r("linear_cka", "linear_cka"))


def _probe(spark, d):
    e = roles.cell_embeddings(spark, d).select("*", *V.magnitude("emb"))
    return L.probe_r2(e, [], F.col("emb"), ["mean_abs", "max_abs"])


PROBE = f"""q_f AS (SELECT cell_id AS rid, d, x FROM embl UNION ALL SELECT cell_id, 65, 1.0 FROM emb), mg AS (SELECT cell_id, avg(abs(x)) AS a, max(abs(x)) AS b FROM embl GROUP BY 1),
  q_y AS (SELECT cell_id AS rid, 1 AS t, a AS y FROM mg UNION ALL SELECT cell_id, 2, b FROM mg), {ridge_sql('q', [], [1e-3], center=False)},
  q_pr AS (SELECT rid, t, sum(w * x) AS p FROM q_f JOIN q_w USING (d) GROUP BY ALL),
  q_out AS (SELECT avg(r2) AS probe_r2 FROM (SELECT t, {R2.format(p='p')} AS r2 FROM q_pr JOIN q_y USING (rid, t) GROUP BY t))"""


@query("M20_linear_probe_r2", f"WITH RECURSIVE {EMB}, {PROBE} SELECT {rd('probe_r2')} AS probe_r2 FROM q_out")
def m20(spark, d):
    return _probe(spark, d).select(r("probe_r2", "probe_r2"))


PROBE1 = f"""{EMB}, p AS (SELECT cell_id, sum(x) AS z, sum(x) FILTER (d IN (1, 41)) AS u0, sum(x) FILTER (d = 42) AS u1 FROM embl GROUP BY 1),
  g AS (SELECT sum(z * z) + 1e-3 AS a, sum(z) AS b, count(*) + 1e-3 AS c, sum(z * u0) AS p0, sum(u0) AS q0, sum(z * u1) AS p1, sum(u1) AS q1 FROM p),
  w AS (SELECT (c * p0 - b * q0) / (a * c - b * b) AS w0, (a * q0 - b * p0) / (a * c - b * b) AS b0, (c * p1 - b * q1) / (a * c - b * b) AS w1, (a * q1 - b * p1) / (a * c - b * b) AS b1 FROM g)
  SELECT {rd('(1 - sum((u0 - w0 * z - b0) * (u0 - w0 * z - b0)) / (var_pop(u0) * count(*)) + 1 - sum((u1 - w1 * z - b1) * (u1 - w1 * z - b1)) / (var_pop(u1) * count(*))) / 2')} AS probe_r2 FROM p, w"""


@query("M20_linear_probe_r2_scalar", f"WITH {PROBE1}")
def m20s(spark, d):
    e = roles.cell_embeddings(spark, d).withColumn("u0", F.col("emb")[40] + F.col("emb")[0]).withColumn("u1", F.col("emb")[41])
    return L.probe_r2(e, [], F.array(V.vsum("emb")), ["u0", "u1"]).select(r("probe_r2", "probe_r2"))


def separability_sql(n: str, cls: str, feats: str) -> str:
    """``{n}_out`` (accuracy, n_folds, chance) for the classes in column ``cls``; ``feats`` gives cell_id, d, x with a constant last."""
    return f"""{n}_x AS ({feats}),
  {n}_k AS (SELECT cell_id, {cls} AS cls, dense_rank() OVER (ORDER BY {cls}) AS t, CAST(ntile(5) OVER (PARTITION BY {cls} ORDER BY md5(concat_ws('|', '0', cell_id))) - 1 AS INTEGER) AS fold FROM emb),
  {n}_h AS (SELECT DISTINCT fold AS out FROM {n}_k), {n}_u AS (SELECT DISTINCT t AS u FROM {n}_k),
  {n}_f AS (SELECT out AS fold, x.cell_id AS rid, d, x FROM {n}_h JOIN {n}_k k ON k.fold <> out JOIN {n}_x x ON x.cell_id = k.cell_id),
  {n}_y AS (SELECT out AS fold, cell_id AS rid, u AS t, CASE WHEN u = t THEN 1.0 ELSE -1.0 END AS y FROM {n}_h JOIN {n}_k k ON k.fold <> out, {n}_u),
  {ridge_sql(n, ['fold'], [1.0], center=False)},
  {n}_sc AS (SELECT x.cell_id, fold, any_value(k.t) AS own, w.t, sum(w * x) AS score FROM {n}_x x JOIN {n}_k k USING (cell_id) JOIN {n}_w w USING (fold, d) GROUP BY x.cell_id, fold, w.t),
  {n}_rn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, t) AS rn FROM {n}_sc),
  {n}_ac AS (SELECT fold, avg(CASE WHEN t = own THEN 1.0 ELSE 0 END) AS acc FROM {n}_rn WHERE rn = 1 GROUP BY 1),
  {n}_out AS (SELECT avg(acc) AS accuracy, count(*) AS n_folds, (SELECT 1.0 / count(*) FROM {n}_u) AS chance FROM {n}_ac)"""


WHOLE = "SELECT cell_id, d, x FROM embl UNION ALL SELECT cell_id, 65, 1.0 FROM emb"
ONE = "SELECT cell_id, 1 AS d, sum(x) AS x FROM embl GROUP BY 1 UNION ALL SELECT cell_id, 2, 1.0 FROM emb"
SEPOUT = f"SELECT {rd('accuracy')} AS accuracy, n_folds, {rd('chance')} AS chance FROM s_out"


@query("M21_context_separability_scalar", f"WITH RECURSIVE {EMB}, {separability_sql('s', 'construct', ONE)} {SEPOUT}")
def m21s(spark, d):
    e = roles.cell_embeddings(spark, d).withColumn("z", F.array(V.vsum("emb")))
    return L.separability(e, "cell_id", "z", "construct").select(r("accuracy", "accuracy"), "n_folds", r("chance", "chance"))


@query("M21_context_separability", f"WITH RECURSIVE {EMB}, {separability_sql('s', 'construct', WHOLE)} {SEPOUT}")
def m21(spark, d):
    e = roles.cell_embeddings(spark, d)
    return L.separability(e, "cell_id", "emb", "construct").select(r("accuracy", "accuracy"), "n_folds", r("chance", "chance"))


CKAS = """ka AS (SELECT batch, cell_id, row_number() OVER (PARTITION BY batch ORDER BY cell_id) AS p, count(*) OVER (PARTITION BY batch) AS n FROM emb),
  kp AS (SELECT a.batch AS ca, b.batch AS cb, a.p, a.cell_id AS ia, b.cell_id AS ib FROM ka a JOIN ka b ON a.p = b.p AND a.n = b.n AND a.batch < b.batch),
  kx AS (SELECT ca, cb, p, d, x FROM kp JOIN embl ON cell_id = ia UNION ALL SELECT ca, cb, p, d + 64, x FROM kp JOIN embl ON cell_id = ib),
  ks AS (SELECT a.ca, a.cb, a.d AS i, b.d AS j, covar_pop(a.x, b.x) * count(*) AS s FROM kx a JOIN kx b USING (ca, cb, p) GROUP BY ALL),
  kc AS (SELECT ca, cb, sum(CASE WHEN i <= 64 AND j > 64 THEN s * s END) / (sqrt(sum(CASE WHEN i <= 64 AND j <= 64 THEN s * s END)) * sqrt(sum(CASE WHEN i > 64 AND j > 64 THEN s * s END))) AS cka FROM ks GROUP BY ALL)"""


@query("M22_representation_bundle", f"""WITH RECURSIVE {MMD}, {PROBE}, {separability_sql('s', 'batch', WHOLE)}, {CKAS}
  SELECT {rd('(SELECT avg(mmd2) FROM mm)')} AS mean_mmd2, {rd('(SELECT avg(cka) FROM kc)')} AS mean_linear_cka, {rd('probe_r2')} AS probe_r2, {rd('accuracy')} AS separability FROM q_out, s_out""")
def m22(spark, d):
    """Mean MMD, mean linear similarity over equal-size contexts aligned by order, probe, separability."""
    from screenloom.functions.ordered import ordinal
    from screenloom.operators.pairs import context_pairs
    e = roles.cell_embeddings(spark, d)
    pos = ordinal(e.select("batch", "cell_id", "emb"), ["batch"], ["cell_id"], "p")
    a = pos.select(F.col("batch").alias("ctx_a"), "p", F.col("p_n").alias("na"), F.col("emb").alias("ea"))
    b = pos.select(F.col("batch").alias("ctx_b"), "p", F.col("p_n").alias("nb"), F.col("emb").alias("eb"))
    same = context_pairs(e, "batch").join(a, "ctx_a").join(b, ["ctx_b", "p"]).where("na = nb")
    cka = L.linear_cka(L.gram(same, ["ctx_a", "ctx_b"], F.concat("ea", "eb")), ["ctx_a", "ctx_b"], 64, 128)
    sep = L.separability(e, "cell_id", "emb", "batch")
    return E.objective(spark, {
        "mean_mmd2": K.mean_mmd2(e, "batch", "cell_id", "emb").select("mean_mmd2"),
        "mean_linear_cka": cka.agg(F.avg("linear_cka")), "probe_r2": _probe(spark, d), "separability": sep.select("accuracy"),
    }, {}).select(*[r(c, c) for c in ("mean_mmd2", "mean_linear_cka", "probe_r2", "separability")])


@query("M26_composite_objective", f"""WITH {MMD}, {SOFT[len(EMB) + 2:]}, {COV[len(EMB) + 2:]},
  e AS (SELECT avg((a.x - b.x) * (a.x - b.x)) AS l_pred FROM embl a JOIN embl b ON a.cell_id = b.cell_id AND b.d = a.d + 32),
  pooled AS (SELECT a.d AS i, b.d AS j, covar_samp(a.x, b.x) AS c FROM half a JOIN half b USING (cell_id) GROUP BY ALL),
  s AS (SELECT sum(CASE WHEN i <= 32 AND j > 32 THEN c * c END) / (sqrt(sum(CASE WHEN i <= 32 AND j <= 32 THEN c * c END)) * sqrt(sum(CASE WHEN i > 32 AND j > 32 THEN c * c END)) + 1e-8) AS l_sep FROM pooled),
  t AS (SELECT l_pred, (SELECT avg(mmd2) FROM mm) AS l_stab, (SELECT avg(1 - rho) FROM sc) AS l_rel, l_sep FROM e, s)
  SELECT {rd('l_pred')} AS l_pred, {rd('l_stab')} AS l_stab, {rd('l_rel')} AS l_rel, {rd('l_sep')} AS l_sep, CAST(0 AS DOUBLE) AS l_off,
         {rd('l_pred + 0.5 * l_stab + 0.1 * l_rel + 0.2 * l_sep')} AS total FROM t""")
def m26(spark, d):
    e = roles.cell_embeddings(spark, d)
    g = L.gram(e, [], F.col("emb"))
    out = E.objective(spark, {
        "l_pred": e.select(F.aggregate(F.zip_with(F.slice("emb", 1, 32), F.slice("emb", 33, 32), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b).alias("q")).agg(F.avg("q") / 32),
        "l_stab": K.mean_mmd2(e, "batch", "cell_id", "emb").select("mean_mmd2"),
        "l_rel": soft_loss(spark, d).select("loss"), "l_sep": L.covariance_penalty(g, [], 32, 64).select("penalty"), "l_off": None,
    }, {"l_stab": 0.5, "l_rel": 0.1, "l_sep": 0.2, "l_off": 3.0})
    return out.select(*[r(c, c) for c in ("l_pred", "l_stab", "l_rel", "l_sep", "l_off", "total")])


ONEF = "tr AS (SELECT {b}regr_slope(y, pred_b) AS b1, regr_intercept(y, pred_b) AS b0 FROM scores WHERE row_key % 10 < 6{g})"


def split_scores(spark, d):
    m = F.col("row_key") % 10
    return roles.scores(spark, d).withColumn("split", F.when(m < 6, "train").when(m < 8, "val").otherwise("test"))


@query("L1_ols_one_feature", f"""WITH {SCORES}, {ONEF.format(b='', g='')} SELECT row_key, {rd('b0 + b1 * pred_b')} AS prediction FROM scores, tr WHERE row_key % 10 >= 6""")
def l1(spark, d):
    s = split_scores(spark, d)
    m = L.fit_linear(s.where("split = 'train'"), ["pred_b"], "y")
    return m.transform(s.where("split <> 'train'")).select("row_key", r("prediction", "prediction"))


@query("L1_ridge_one_feature", f"""WITH {SCORES}, t AS (SELECT avg(pred_b) mx, avg(y) my, var_pop(pred_b) * count(*) sxx, covar_pop(pred_b, y) * count(*) sxy FROM scores WHERE row_key % 10 < 6)
  SELECT row_key, {rd('my + sxy / (sxx + 10.0) * (pred_b - mx)')} AS prediction FROM scores, t WHERE row_key % 10 >= 6""")
def l1r(spark, d):
    s = split_scores(spark, d)
    m = L.fit_linear(s.where("split = 'train'"), ["pred_b"], "y", alpha=10.0)
    return m.transform(s.where("split <> 'train'")).select("row_key", r("prediction", "prediction"))


def _mag_model_rows(spark, d):
    rows = durable(labelled(spark, d))
    stats = X.fit_scaler(rows, [*MAG, "log_n"])
    return durable(X.apply_scaler(rows, stats, [*MAG, "log_n"]).withColumn("key", F.concat_ws("|", *KEYS)))


@query("L6_linear_secondaries_one_feature", f"""WITH {LABELLED}, f AS (SELECT regr_slope(y, max_abs) AS a1, regr_intercept(y, max_abs) AS a0, regr_slope(y, log_n) AS c1, regr_intercept(y, log_n) AS c0 FROM lab WHERE split = 'train'),
  p AS (SELECT split, y, a0 + a1 * max_abs AS pm, c0 + c1 * log_n AS pc FROM lab, f)
  SELECT split, {rd(R2.format(p='pm'))} AS max_r2, {rd(R2.format(p='pc'))} AS count_r2 FROM p WHERE split <> 'train' GROUP BY 1""")
def l6(spark, d):
    """One-feature closed forms on unscaled features: scaling does not change their predictions."""
    lab = durable(labelled(spark, d))
    f = lab.where("split = 'train'").agg(
        F.regr_slope("y", "max_abs").alias("a1"), F.regr_intercept("y", "max_abs").alias("a0"),
        F.regr_slope("y", "log_n").alias("c1"), F.regr_intercept("y", "log_n").alias("c0"))
    p = lab.where("split <> 'train'").withColumn("f", f.select(F.struct(*f.columns)).scalar())
    p = p.withColumn("pm", F.col("f.a0") + F.col("f.a1") * F.col("max_abs")).withColumn("pc", F.col("f.c0") + F.col("f.c1") * F.col("log_n"))
    return p.groupBy("split").agg(r(S.r2("y", "pm"), "max_r2"), r(S.r2("y", "pc"), "count_r2"))


SECONDARY = {"MAG": MAG, "MAX": ["max_abs"], "COUNT": ["log_n"], "MAG+COUNT": [*MAG, "log_n"]}
L6F = " UNION ALL ".join(f"SELECT '{arm}' AS arm, rid, split, {i + 1} AS d, {c} AS x FROM lb" for arm, cs in SECONDARY.items() for i, c in enumerate(cs))
L6SQL = f"""{LABELLED}, lb AS (SELECT *, concat_ws('|', split, batch, target) AS rid FROM lab), fr AS ({L6F}),
  fs AS (SELECT arm, d, avg(x) AS u, stddev_pop(x) AS v FROM fr WHERE split = 'train' GROUP BY ALL),
  fx AS (SELECT arm, rid, split, d, (x - u) / CASE WHEN v > 0 THEN v ELSE 1 END AS x FROM fr JOIN fs USING (arm, d)),
  q_f AS (SELECT arm, rid, d, x FROM fx WHERE split = 'train'), q_y AS (SELECT DISTINCT arm, lb.rid, 1 AS t, y FROM lb JOIN q_f USING (rid)), {ridge_sql('q', ['arm'], [0.0])},
  pr AS (SELECT arm, fx.split, rid, any_value(my) + sum(w * (x - mx)) AS p, any_value(y) AS y FROM fx JOIN q_w USING (arm, d) JOIN q_m USING (arm, d) JOIN q_my USING (arm) JOIN lb USING (rid) WHERE fx.split <> 'train' GROUP BY arm, fx.split, rid),
  rk AS (SELECT *, {avg_rank('y', 'arm, split')} AS ry, {avg_rank('p', 'arm, split')} AS rp FROM pr)
  SELECT arm, split, count(*) AS n, {rd(R2.format(p='p'), 4)} AS r2, {rd(pear('ry', 'rp'), 4)} AS rho FROM rk GROUP BY ALL"""


@query("L6_linear_secondaries", f"WITH RECURSIVE {L6SQL}")
def l6m(spark, d):
    """MAG, MAX, COUNT and MAG+COUNT fitted once on training rows, scored elsewhere."""
    rows = _mag_model_rows(spark, d)
    s = durable(E.sweep(rows, SECONDARY, {"ols": lambda t, f, y, seed: L.fit_linear(t, f, y)}, [0], "key", "y"))
    rho = M.spearman(s, ["arm", "split"], {"rho": ("y", "yhat")})
    return s.groupBy("arm", "split").agg(F.count("*").alias("n"), S.r2("y", "yhat").alias("r2")).join(rho, ["arm", "split"]).select(
        "arm", "split", "n", r("r2", "r2", 4), r("rho", "rho", 4))


@query("L2_tree_heads")
def l2(spark, d):
    """Forest and boosted trees on two score features; smaller than the published settings."""
    s = split_scores(spark, d).withColumn("held", F.col("row_key") % 10 == 5)
    train = s.where("split = 'train'")
    rf = L.fit_forest(train, ["pred_a", "pred_b"], "y", 0, trees=10, depth=6)
    gb = L.fit_boosted(train, ["pred_a", "pred_b"], "y", 0, rounds=10, depth=4, held_out="held")
    out = None
    for name, m in (("forest", rf), ("boosted", gb)):
        one = m.transform(s.where("split <> 'train'")).groupBy("split").agg(F.count("*").alias("n"), r(S.r2("y", "prediction"), "r2", 3)).withColumn("family", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


BINS, LEVELS, TREES, STEP, LEAF = 32, 3, 2, 0.05, 20


def _boosting_sql() -> str:
    """Trees of the two score features by even and odd keys: bins by rank, every level from its rows, no sibling by subtraction."""
    k = "PARTITION BY grp, node"
    sql = f"""{SCORES}, tr AS (SELECT row_key % 2 AS grp, row_key, y, pred_a, pred_b FROM scores WHERE row_key % 10 < 5),
  lf AS (SELECT grp, row_key, 0 AS feature, pred_a AS x FROM tr UNION ALL SELECT grp, row_key, 1, pred_b FROM tr),
  rk AS (SELECT grp, feature, x, row_number() OVER (PARTITION BY grp, feature ORDER BY x) AS p, count(*) OVER (PARTITION BY grp, feature) AS m FROM lf),
  eg AS (SELECT DISTINCT grp, feature, x AS edge FROM rk JOIN (SELECT unnest(range(1, {BINS})) AS q) ON p = ceil(q * m / {BINS}.0)),
  en AS (SELECT *, row_number() OVER (PARTITION BY grp, feature ORDER BY edge) AS e FROM eg),
  b AS (SELECT lf.grp, row_key, lf.feature, count(edge) AS bin FROM lf LEFT JOIN en ON en.grp = lf.grp AND en.feature = lf.feature AND edge < x GROUP BY ALL),
  g0 AS (SELECT grp, row_key, y - avg(y) OVER (PARTITION BY grp) AS g FROM tr)"""
    out = []
    for t in range(TREES):
        sql += f", n{t}_0 AS (SELECT grp, row_key, 0 AS node FROM tr)"
        for v in range(LEVELS):
            sql += f""", h{t}_{v} AS (SELECT grp, node, feature, bin, sum(g) AS s, count(*) AS n FROM n{t}_{v} JOIN g{t} USING (grp, row_key) JOIN b USING (grp, row_key) GROUP BY ALL),
  c{t}_{v} AS (SELECT *, sum(s) OVER ({k}, feature ORDER BY bin) AS sl, sum(n) OVER ({k}, feature ORDER BY bin) AS nl, sum(s) OVER ({k}, feature) AS ss, sum(n) OVER ({k}, feature) AS nn FROM h{t}_{v}),
  k{t}_{v} AS (SELECT grp, node, feature, bin AS cut, sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl) - ss * ss / nn AS gain FROM c{t}_{v} WHERE nl >= {LEAF} AND nn - nl >= {LEAF}
    QUALIFY gain > 1e-10 AND row_number() OVER ({k} ORDER BY gain DESC, feature, bin) = 1),
  n{t}_{v + 1} AS (SELECT grp, row_key, 2 * node + 1 + CAST(bin > cut AS INTEGER) AS node FROM n{t}_{v} JOIN k{t}_{v} USING (grp, node) JOIN b USING (grp, row_key, feature))"""
        every = " UNION ALL ".join(f"SELECT * FROM n{t}_{v}" for v in range(LEVELS + 1))
        cuts = " UNION ALL ".join(f"SELECT * FROM k{t}_{v}" for v in range(LEVELS))
        sql += f""", z{t} AS ({every}), k{t} AS ({cuts}), v{t} AS (SELECT grp, node, count(*) AS n, {STEP} * avg(g) AS value FROM z{t} JOIN g{t} USING (grp, row_key) GROUP BY ALL),
  g{t + 1} AS (SELECT grp, row_key, g - value AS g FROM (SELECT grp, row_key, max(node) AS node FROM z{t} GROUP BY ALL) JOIN v{t} USING (grp, node) JOIN g{t} USING (grp, row_key))"""
        out.append(f"""SELECT grp, {t} AS tree, node, k{t}.feature, {rd('edge', 9)} AS threshold, {rd('gain', 5)} AS gain, n, {rd('value', 8)} AS value
  FROM v{t} LEFT JOIN k{t} USING (grp, node) LEFT JOIN en ON en.grp = v{t}.grp AND en.feature = k{t}.feature AND e = cut + 1""")
    return f"WITH {sql} {' UNION ALL '.join(out)}"


@query("L2_boosted_trees", _boosting_sql())
def l2b(spark, d):
    """Every node of the first boosted trees of two models that are fitted together."""
    s = roles.scores(spark, d).where("row_key % 10 < 6").selectExpr("row_key % 2 AS grp", "array(pred_a, pred_b) AS x", "y", "row_key % 10 = 5 AS held")
    m = boosting.fit(s, ["grp"], "x", "y", "held", rounds=TREES, depth=LEVELS, step=STEP, bins=BINS, leaf=LEAF)
    return m.table(spark).select("grp", "tree", "node", "feature", r("threshold", "threshold", 9), r("gain", "gain", 5), "n", r("value", "value", 8))


def _vector_rows(spark, d):
    """cell_id, split, y and the vector arms: z, m, and the controls C1 to C5.

    What a row gives by itself, above all the hashed noise, is made once, in tasks for all cores however few bytes the
    rows have; the permutations then read only the columns they move."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = emb_rows(spark, d).repartition(tasks, "cell_id").select("*", *V.magnitude("emb"))
    e = e.withColumn("m", F.array("mean_abs", F.round("l2", 6), "max_abs", "sd")).drop(*MAG)
    e = e.withColumn("C1", C.noise("cell_id", 68, C.SEEDS["C1"])).withColumn("C5", C.noise("cell_id", 4, C.SEEDS["C5"]))
    e = C.project(e, "emb", C.projection_matrix(spark, 64, 16), "C2")
    y = F.substring("construct", 2, 9).cast("double") + F.col("emb")[0] + F.col("m")[2]
    e = durable(e.select("cell_id", "split", y.alias("y"), F.col("emb").alias("z"), "m", "C1", "C2", "C5"))
    lone = e.select("split", "cell_id", F.col("z").alias("C3"))
    mags = e.select("split", "cell_id", F.col("m").alias("C4"))
    c3 = C.shuffled(lone, "cell_id", ["C3"], C.SEEDS["C3"]).select("cell_id", "C3")
    c4 = C.shuffled(mags, "cell_id", ["C4"], C.SEEDS["C4"]).select("cell_id", "C4")
    return durable(e.join(c3, "cell_id").join(c4, "cell_id"))


VECTOR_ARMS = {"z": ["z"], "m": ["m"], "zm": ["z", "m"], "C1": ["C1"], "C2": ["C2"], "C3": ["C3"], "C4": ["z", "C4"], "C5": ["z", "C5"]}


@query("L3_sweep_select_freeze_test")
def l3(spark, d):
    """All vector arms, three families, three seeds; trees smaller than the functions' defaults."""
    rows = _vector_rows(spark, d)
    fams = {
        "ridge": lambda t, f, y, seed: L.fit_linear(t, f, y, alpha=1.0),
        "forest": lambda t, f, y, seed: L.fit_forest(t, f, y, seed, trees=10, depth=5),
    }
    boosted = E.sweep_boosted(rows, VECTOR_ARMS, [0, 1, 2], "cell_id", "y", rounds=6, depth=4, step=0.3)
    s = durable(E.sweep(rows, VECTOR_ARMS, fams, [0, 1, 2], "cell_id", "y", seedless=("ridge",)).unionByName(boosted))
    frozen = E.freeze(E.validation_table(s.where("split = 'val'")))
    t = E.test_table(frozen, s)
    return t.select("arm", "family", *[r(c, c, 3) for c in ("r2_mean", "r2_sd", "spearman_mean", "spearman_sd")], "n_seeds")


ER = f"""er AS (SELECT cell_id, {SPLITOF} AS split FROM emb), mg AS (SELECT cell_id, avg(abs(x)) AS m1, round(sqrt(sum(x * x)), 6) AS m2, max(abs(x)) AS m3, stddev_pop(x) AS m4 FROM embl GROUP BY 1),
  ml AS (SELECT cell_id, unnest([1, 2, 3, 4]) AS d, unnest([m1, m2, m3, m4]) AS x FROM mg),
  prj AS (SELECT cell_id, j AS d, sum(x * r) AS x FROM embl JOIN (SELECT i, j, {normal(20270102, 'i', 'j')} / sqrt(16.0) AS r FROM (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 17)) AS j)) ON d = i GROUP BY ALL)"""


def noise_sql(seed: int, dim: int) -> str:
    return f"SELECT cell_id, i AS d, {nsql(seed)} AS x FROM (SELECT cell_id FROM emb), (SELECT unnest(range(1, {dim + 1})) AS i)"


PERM4 = permsql(20270104, "er").replace("pl AS", "pl4 AS").replace("so AS", "so4 AS").replace("FROM pl JOIN so", "FROM pl4 JOIN so4").replace("perm AS", "perm4 AS")
L3V = f"""{EMB}, {ER}, {permsql(20270103, 'er')}, {PERM4},
  fr AS (SELECT 'z' AS arm, cell_id, d, x FROM embl UNION ALL SELECT 'm', cell_id, d, x FROM ml
    UNION ALL SELECT 'zm', cell_id, d, x FROM embl UNION ALL SELECT 'zm', cell_id, d + 64, x FROM ml
    UNION ALL SELECT 'C1', cell_id, d, x FROM ({noise_sql(20270101, 68)}) UNION ALL SELECT 'C2', cell_id, d, x FROM prj
    UNION ALL SELECT 'C3', p.cell_id, d, x FROM perm p JOIN embl e ON e.cell_id = donor
    UNION ALL SELECT 'C4', cell_id, d, x FROM embl UNION ALL SELECT 'C4', p.cell_id, d + 64, x FROM perm4 p JOIN ml e ON e.cell_id = donor
    UNION ALL SELECT 'C5', cell_id, d, x FROM embl UNION ALL SELECT 'C5', cell_id, d + 64, x FROM ({noise_sql(20270105, 4)})),
  yy AS (SELECT cell_id, CAST(substr(construct, 2) AS DOUBLE) + emb[1] + m3 AS y FROM emb JOIN mg USING (cell_id)),
  fs AS (SELECT arm, d, avg(x) AS u, stddev_pop(x) AS v FROM fr JOIN er USING (cell_id) WHERE split = 'train' GROUP BY ALL),
  fx AS (SELECT arm, cell_id, split, d, (x - u) / CASE WHEN v > 0 THEN v ELSE 1 END AS x FROM fr JOIN fs USING (arm, d) JOIN er USING (cell_id)),
  q_f AS (SELECT arm, cell_id AS rid, d, x FROM fx WHERE split = 'train'), q_y AS (SELECT DISTINCT arm, cell_id AS rid, 1 AS t, y FROM fx JOIN yy USING (cell_id) WHERE split = 'train'), {ridge_sql('q', ['arm'], [1.0, 300.0])},
  pr AS (SELECT arm, alpha, split, cell_id, any_value(my) + sum(w * (x - mx)) AS p, any_value(y) AS y FROM fx JOIN q_w USING (arm, d) JOIN q_m USING (arm, d) JOIN q_my USING (arm) JOIN yy USING (cell_id) WHERE split <> 'train' GROUP BY arm, alpha, split, cell_id),
  vr AS (SELECT arm, alpha, {R2.format(p='p')} AS r2 FROM pr WHERE split = 'val' GROUP BY ALL),
  ch AS (SELECT arm, alpha FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY r2 DESC, alpha) AS rn FROM vr) WHERE rn = 1),
  rk AS (SELECT *, {avg_rank('y', 'arm')} AS ry, {avg_rank('p', 'arm')} AS rp FROM pr JOIN ch USING (arm, alpha) WHERE split = 'test')
  SELECT arm, CASE WHEN any_value(alpha) = 1 THEN 'ridge' ELSE 'ridge_strong' END AS family, {rd(R2.format(p='p'))} AS r2_mean, {rd(pear('ry', 'rp'))} AS spearman_mean, CAST(3 AS BIGINT) AS n_seeds FROM rk GROUP BY arm"""


@query("L3_vector_arms_linear", f"WITH RECURSIVE {L3V}")
def l3v(spark, d):
    """All arms as vectors, scaled by training rows; two penalties compete on validation, seeds 0, 1, 2."""
    fams = {
        "ridge": lambda t, f, y, seed: L.fit_linear(t, f, y, alpha=1.0),
        "ridge_strong": lambda t, f, y, seed: L.fit_linear(t, f, y, alpha=300.0),
    }
    s = durable(E.sweep(_vector_rows(spark, d), VECTOR_ARMS, fams, [0, 1, 2], "cell_id", "y", seedless=tuple(fams)))
    t = E.test_table(E.freeze(E.validation_table(s.where("split = 'val'"))), s)
    return t.select("arm", "family", r("r2_mean", "r2_mean"), r("spearman_mean", "spearman_mean"), "n_seeds")


L4SQL = f"""{EMB}, {ER}, {permsql(20270103, 'er')},
  fr AS (SELECT 'z' AS arm, cell_id, d, x FROM embl UNION ALL SELECT 'ceiling_x', cell_id, d, abs(x) FROM embl UNION ALL SELECT 'C2', cell_id, d, x FROM prj
    UNION ALL SELECT 'C3', p.cell_id, d, x FROM perm p JOIN embl e ON e.cell_id = donor),
  q_f AS (SELECT arm, cell_id AS rid, d, x FROM fr JOIN er USING (cell_id) WHERE split = 'train'),
  q_y AS (SELECT arm, cell_id AS rid, d AS t, x AS y FROM ml JOIN er USING (cell_id), (SELECT DISTINCT arm FROM fr) WHERE split = 'train'), {ridge_sql('q', ['arm'], L.ALPHAS)},
  pr AS (SELECT arm, alpha, t, cell_id, any_value(my) + sum(w * (fr.x - mx)) AS p, any_value(ml.x) AS y FROM fr JOIN er USING (cell_id) JOIN q_w USING (arm, d) JOIN q_m USING (arm, d) JOIN q_my USING (arm, t) JOIN ml ON ml.cell_id = fr.cell_id AND ml.d = t
    WHERE split = 'val' GROUP BY arm, alpha, t, fr.cell_id AS cell_id),
  gr AS (SELECT arm, t, alpha, {R2.format(p='p')} AS r2 FROM pr GROUP BY ALL),
  bs AS (SELECT arm, t, max((r2, alpha)) FILTER (r2 IS NOT NULL) AS b, count(r2) AS n_finite FROM gr GROUP BY ALL)
  SELECT arm, ['mean_abs', 'l2', 'max_abs', 'sd'][t] AS component, b[2] AS selected_alpha, {rd('b[1]', 4)} AS selected_r2, n_finite,
    (SELECT count(*) > 1 FROM gr WHERE gr.arm = bs.arm AND gr.t = bs.t AND gr.r2 = b[1]) AS tie_applied, CASE WHEN n_finite > 0 THEN 'OK' ELSE 'PROBE_DEGENERATE' END AS status, true AS repeats_identical FROM bs"""
L4SQL = L4SQL.replace("GROUP BY arm, alpha, t, fr.cell_id AS cell_id", "GROUP BY arm, alpha, t, fr.cell_id").replace("SELECT arm, alpha, t, cell_id, any_value(my)", "SELECT arm, alpha, t, fr.cell_id, any_value(my)")


@query("L4_recoverability_probe_grid", f"WITH RECURSIVE {L4SQL}")
def l4(spark, d):
    """Four inputs, four magnitude targets, seven penalties, three repeats that must agree.

    The given vectors have unit length, so the length is a target that cannot be probed."""
    from screenloom.operators.audit import repeats_agree
    e = emb_rows(spark, d).select("*", *V.magnitude("emb")).withColumn("l2", F.round("l2", 6))
    e = C.project(e, "emb", C.projection_matrix(spark, 64, 16), "c2")
    e = e.join(C.shuffled(e.select("split", "cell_id", F.col("emb").alias("c3")), "cell_id", ["c3"], C.SEEDS["C3"]).select("cell_id", "c3"), "cell_id")
    e = durable(e)
    arms = {"z": F.col("emb"), "ceiling_x": F.transform("emb", lambda v: F.abs(v)), "C2": F.col("c2"), "C3": F.col("c3")}
    grid = durable(E.probe_grid(e.where("split = 'train'"), e.where("split = 'val'"), arms, {"z": 64, "ceiling_x": 64, "C2": 16, "C3": 64}, MAG, repeats=3))
    agree = repeats_agree(grid.withColumn("r2", F.round("r2", 9)), ["arm", "target", "alpha"], "r2").select("pass").scalar()
    sel = M.select_alpha(grid.where("repeat = 1"), ["arm", "target"])
    return sel.select("arm", F.element_at(F.array(*[F.lit(m) for m in MAG]), F.col("target") + 1).alias("component"),
                      "selected_alpha", r("selected_r2", "selected_r2", 4), "n_finite", "tie_applied", "status", agree.alias("repeats_identical"))


ZS = f"""{SCORES}, st AS (SELECT s.*, o_orderstatus AS os FROM scores s JOIN orders ON row_key = o_orderkey),
  f AS (SELECT regr_slope(y, pred_b) AS b1, regr_intercept(y, pred_b) AS b0 FROM st WHERE os <> 'F' AND row_key % 10 < 6)
  SELECT row_key, {rd('b0 + b1 * pred_b')} AS prediction FROM st, f WHERE os = 'F'"""


def _away(spark, d, feats):
    """Scaler and model from one screen's training rows; the rows of another (order status F)."""
    from screenloom.sources.tables import read
    s = split_scores(spark, d)
    st = read(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).withColumnRenamed("o_orderkey", "row_key")
    s = s.join(st, "row_key")
    home = s.where("o_orderstatus <> 'F'")
    stats = durable(X.fit_scaler(home, feats))
    model = L.fit_linear(X.apply_scaler(home.where("split = 'train'"), stats, feats), feats, "y")
    return E.zero_shot(model, stats, s.where("o_orderstatus = 'F'"), feats)


@query("L5_zero_shot_one_feature", f"WITH {ZS}")
def l5one(spark, d):
    return _away(spark, d, ["pred_b"]).select("row_key", r("prediction", "prediction"))


@query("L5_zero_shot_scoring", f"""WITH RECURSIVE {ZS[:ZS.index('f AS (SELECT regr')]} fr AS (SELECT row_key AS rid, 1 AS d, pred_a AS x FROM st UNION ALL SELECT row_key, 2, pred_b FROM st),
  q_f AS (SELECT rid, d, x FROM fr JOIN st ON rid = row_key WHERE os <> 'F' AND rid % 10 < 6), q_y AS (SELECT row_key AS rid, 1 AS t, y FROM st WHERE os <> 'F' AND row_key % 10 < 6), {ridge_sql('q', [], [0.0])},
  pr AS (SELECT rid, any_value(context) AS context, any_value(y) AS y, any_value(my) + sum(w * (x - mx)) AS p FROM fr JOIN st ON rid = row_key JOIN q_w USING (d) JOIN q_m USING (d), q_my WHERE os = 'F' GROUP BY rid),
  rk AS (SELECT *, {avg_rank('y', 'context')} AS ry, {avg_rank('p', 'context')} AS rp FROM pr)
  SELECT context, {rd(pear('ry', 'rp'), 4)} AS rho FROM rk GROUP BY 1""")
def l5(spark, d):
    away = _away(spark, d, ["pred_a", "pred_b"])
    return M.spearman(away, ["context"], {"rho": ("prediction", "y")}).select("context", r("rho", "rho", 4))


LIN = f"""{SCORES}, fe AS (SELECT row_key, row_key % 10 AS m, y, 'a' AS arm, pred_a AS x FROM scores UNION ALL SELECT row_key, row_key % 10, y, 'b', pred_b FROM scores),
  t AS (SELECT arm, count(*) AS n, avg(x) mx, avg(y) my, var_pop(x) * count(*) sxx, covar_pop(x, y) * count(*) sxy FROM fe WHERE m < 6 GROUP BY 1),
  fm AS (SELECT * FROM (VALUES ('ols', 0.0), ('ridge', 1000.0)) v(family, al)),
  pr AS (SELECT arm, family, m, y, my + sxy / (sxx * (1 + al / n)) * (x - mx) AS p FROM fe JOIN t USING (arm), fm WHERE m >= 6),
  vr AS (SELECT arm, family, {R2.format(p='p')} AS r2 FROM pr WHERE m < 8 GROUP BY ALL),
  ch AS (SELECT arm, family FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY r2 DESC, family) AS rn FROM vr) WHERE rn = 1)
  SELECT arm, family, {rd(R2.format(p='p'))} AS r2_mean, CAST(1 AS BIGINT) AS n_seeds FROM pr JOIN ch USING (arm, family) WHERE m >= 8 GROUP BY ALL"""


def _linear_sweep(spark, d):
    rows = split_scores(spark, d)
    fams = {"ols": lambda t, f, y, seed: L.fit_linear(t, f, y), "ridge": lambda t, f, y, seed: L.fit_linear(t, f, y, alpha=1000.0)}
    s = durable(E.sweep(rows, {"a": ["pred_a"], "b": ["pred_b"]}, fams, [0], "row_key", "y"))
    return s, E.freeze(E.validation_table(s.where("split = 'val'")))


@query("L3_linear_sweep_select_freeze_test", f"WITH {LIN}")
def l3lin(spark, d):
    s, frozen = _linear_sweep(spark, d)
    return E.test_table(frozen, s).select("arm", "family", r("r2_mean", "r2_mean"), "n_seeds")


@query("Q14_freeze_before_test", f"""WITH {LIN.split('  SELECT arm, family, ')[0]} SELECT 'freeze_before_test' AS check_name, count(*) FILTER (n <> 1) AS n_bad, count(*) FILTER (n <> 1) = 0 AS pass
  FROM (SELECT arm, count(*) AS n FROM ch GROUP BY 1)""")
def q14(spark, d):
    """Every frozen arm is tested once with the frozen family, under the digest that the written choice
    had before the first test row was scored and still has."""
    s, frozen = _linear_sweep(spark, d)
    tested = E.test_table(frozen, s).select("arm", "family", "frozen")
    chosen = frozen.table.select("arm", F.col("selected").alias("family"))
    same = chosen.join(tested.where(F.col("frozen") == frozen.content()), ["arm", "family"], "left")
    from screenloom.operators.audit import check
    return check(same, "freeze_before_test", F.col("frozen").isNull()).select("check_name", "n_bad", "pass")


@query("L7_reproduction_gate", f"""WITH {SCORES}, m AS (SELECT 'pred_' || CASE WHEN k = 0 THEN 'a' ELSE 'b' END AS item, seed, {R2.format(p='p')} AS r2 FROM (
    SELECT 0 AS k, 0 AS seed, y, pred_a AS p FROM scores UNION ALL SELECT 1, row_key % 3, y, pred_b FROM scores) GROUP BY ALL),
  a AS (SELECT item, avg(r2) AS mean, stddev_samp(r2) AS sd, min(r2) AS lo, max(r2) AS hi, count(*) AS k FROM m GROUP BY 1),
  e AS (SELECT * FROM (VALUES ('pred_a', 0.208::DOUBLE), ('pred_b', -2.0::DOUBLE), ('absent', 0.1::DOUBLE)) t(item, expected))
  SELECT item, expected, {rd('mean')} AS mean, {rd('sd')} AS sd, k,
    coalesce(CASE WHEN k = 1 THEN abs(mean - expected) <= 0.005 ELSE abs(mean - expected) <= 2 * sd OR expected BETWEEN lo AND hi END, false) AS pass
  FROM e LEFT JOIN a USING (item)""")
def l7(spark, d):
    s = roles.scores(spark, d)
    a = s.select(F.lit("pred_a").alias("item"), F.lit(0).cast("bigint").alias("seed"), "y", F.col("pred_a").alias("p"))
    b = s.select(F.lit("pred_b").alias("item"), (F.col("row_key") % 3).alias("seed"), "y", F.col("pred_b").alias("p"))
    m = a.unionByName(b).groupBy("item", "seed").agg(S.r2("y", "p").alias("r2"))
    e = spark.createDataFrame([("pred_a", 0.208), ("pred_b", -2.0), ("absent", 0.1)], "item string, expected double")
    g = E.reproduction_gate(m, e, "item")
    return g.select("item", "expected", r("mean", "mean"), r("sd", "sd"), "k", "pass")


@query("L7_overall_verdict", f"""WITH g AS ({ORACLES['L7_reproduction_gate']})
  SELECT count(*) AS n_items, count(*) FILTER (pass) AS n_passed, count(*) > 0 AND count(*) = count(*) FILTER (pass) AS pass FROM g""")
def l7all(spark, d):
    """Every item has to pass, one that was never measured included."""
    return E.overall(l7(spark, d))
