"""Scans, normalisation, group profiles, feature selection and scaling."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from screenloom.functions import vector as V
from screenloom.operators import features as X, normalize as N, pseudobulk as P
from screenloom.plans.registry import query, r
from screenloom.plans.sqltext import (
    BULK, CELLS, COUNTS, CTRL, EMB, FULL, NCTRL, NORM, SCREEN, SIZES, rd,
)
from screenloom.sources import roles
from screenloom.session import durable
from screenloom.sources.roles import CONTROL

KEYS = ["split", "batch", "target"]
MAG = ["mean_abs", "l2", "max_abs", "sd"]


class Screen:
    """The stages of one screen, each a lazy plan built when first asked for.

    Profiles and baselines both come from the per-group sums of one pass over the counts.  With
    ``keep`` these sums, a table of groups x genes, are written once, so that several uses in one
    query do not read and normalise the counts again."""

    def __init__(self, spark, d, min_cells=10, keep=True, genes=roles.N_GENES):
        self.spark, self.d, self.min_cells, self.keep, self.genes = spark, d, min_cells, keep, genes

    @cached_property
    def cells(self):
        return roles.cells(self.spark, self.d)

    @cached_property
    def norm(self):
        return N.library_log1p(roles.counts(self.spark, self.d, self.genes))

    @cached_property
    def axis(self) -> int:
        """Number of genes: the given one, or that of the genes with any count."""
        return self.genes or self.norm.agg(F.count_distinct("gene_idx")).first()[0]

    @cached_property
    def treated(self):
        return N.treated(self.cells, CONTROL)

    @cached_property
    def controls(self):
        return N.controls(self.cells, CONTROL)

    @cached_property
    def sizes(self):
        return N.group_sizes(self.treated, KEYS, self.min_cells)

    @cached_property
    def tasks(self) -> list[int]:
        """To how many tasks entries on a wide axis are dealt."""
        return [] if self.genes else roles.more_tasks(self.spark, roles.entries(self.spark, self.d))

    @cached_property
    def sums(self):
        sums = P.group_sums(self.norm, self.cells, KEYS, self.tasks)
        return durable(sums) if self.keep else sums

    @cached_property
    def profile(self):
        # written sums have lost their dealing
        return P.means(N.treated(self.sums, CONTROL), self.sizes, KEYS, self.tasks if self.keep else [])

    @cached_property
    def base(self):
        sizes = N.group_sizes(self.controls, ["batch"])
        return P.means(N.controls(self.sums, CONTROL), sizes, ["batch"]).select("batch", "gene_idx", "mean")

    @cached_property
    def delta(self):
        tasks = []
        if not self.genes:
            per = self.base.groupBy("batch").agg(F.count(F.lit(1)).alias("g"))
            made = self.sizes.join(per, "batch").agg(F.coalesce(F.sum("g"), F.lit(0))).first()[0]
            tasks = roles.more_tasks(self.spark, made + roles.entries(self.spark, self.d))
        return P.delta(self.profile, self.sizes, self.base, KEYS, ["batch"], tasks)


def magnitude_rows(s: Screen):
    """split, batch, target, n_cells and the four magnitude scalars of the delta over all genes.

    Scalars come from sums over the long rows (absent genes are zeros), not from packed arrays."""
    g = s.axis
    d = F.col("delta")
    m = s.delta.groupBy(*KEYS).agg(
        (F.sum(F.abs(d)) / g).alias("mean_abs"),
        F.sqrt(F.sum(d * d)).alias("l2"),
        F.max(F.abs(d)).alias("max_abs"),
        F.count(F.lit(1)).alias("k"), F.avg(d).alias("m"), F.var_pop(d).alias("v"),
    )
    m2 = F.col("v") * F.col("k") + F.col("m") * F.col("m") * F.col("k") * (g - F.col("k")) / g
    return m.join(s.sizes, KEYS).select(
        *KEYS, "n_cells", "mean_abs", "l2", "max_abs", F.sqrt(m2 / g).alias("sd")
    )


MAGROWS = FULL + """, dense AS (
  SELECT s.split, s.batch, s.target, s.n_cells, g.gene_idx, coalesce(delta, 0) AS x
  FROM sizes s CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS gene_idx) g
  LEFT JOIN delta USING (split, batch, target, gene_idx)),
mag AS (
  SELECT split, batch, target, any_value(n_cells) AS n_cells, avg(abs(x)) AS mean_abs, sqrt(sum(x * x)) AS l2,
         max(abs(x)) AS max_abs, stddev_pop(x) AS sd FROM dense GROUP BY ALL)"""


@query("S1_treated_cells_of_batch", f"""WITH {CELLS}
  SELECT cell_id, split, target FROM cells WHERE batch = '1996' AND target <> 'T0'""")
def s1(spark, d):
    from screenloom.sources.tables import read_rows
    return read_rows(roles.cells(spark, d), "1996", CONTROL).select("cell_id", "split", "target")


@query("S2_column_restricted_read", "SELECT o_orderkey, o_custkey FROM orders")
def s2(spark, d):
    from screenloom.operators.audit import guard_columns
    from screenloom.sources.tables import read
    wanted = guard_columns(["o_orderkey", "o_custkey"], deny=["o_totalprice"])
    return read(spark, d, "orders", wanted)


@query("S3_eligible_list", """SELECT DISTINCT 'T' || CAST(c_custkey % 32 AS VARCHAR) AS target FROM customer
  WHERE c_acctbal > 9000""")
def s3(spark, d):
    """A list written and read back as CSV with a stated schema, then filtered on eligibility."""
    from screenloom.session import shared_dir
    from screenloom.sources.tables import read, read_list
    import uuid
    path = f"{shared_dir(spark)}/lists/{uuid.uuid4().hex}"
    (read(spark, d, "customer", ["c_custkey", "c_acctbal"])
     .select(F.concat(F.lit("T"), (F.col("c_custkey") % 32).cast("string")).alias("target"),
             (F.col("c_acctbal") > 9000).alias("eligible"))
     .write.option("header", True).csv(path))
    return read_list(spark, path, "target string, eligible boolean", "eligible").select("target").distinct()


@query("S4_flat_columns_to_vector", """SELECT vec_id, """ + rd("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))") +
       """ AS total, """ + rd("CAST(embedding[11] AS DOUBLE)") + """ AS eleventh FROM embeddings""")
def s4(spark, d):
    from screenloom.sources.tables import pack_columns, read
    e = read(spark, d, "embeddings")
    flat = e.select("vec_id", *[F.col("embedding")[i].alias(f"z_emb_{i}") for i in range(64)])
    packed = pack_columns(flat, r"z_emb_\d+", "z", ["vec_id"])
    return packed.select("vec_id", r(V.vsum("z"), "total"), r(F.col("z")[10], "eleventh"))


@query("P1_library_log1p_floor", f"""WITH {COUNTS},
  t AS (SELECT *, sum(cnt) OVER (PARTITION BY cell_id) AS total FROM counts)
  SELECT cell_id, gene_idx, {rd("ln(1 + cnt * 10000.0 / CASE WHEN total < 1 THEN 1 ELSE total END)")} AS v FROM t""")
def p1(spark, d):
    return N.library_log1p(roles.counts(spark, d), floor=1.0).select("cell_id", "gene_idx", r("v", "v"))


@query("P2_cp10k_log1p", f"WITH {COUNTS}, {NORM} SELECT cell_id, gene_idx, {rd('v')} AS v FROM norm")
def p2(spark, d):
    return N.library_log1p(roles.counts(spark, d)).select("cell_id", "gene_idx", r("v", "v"))


@query("P3_control_treated_split", f"""WITH {CELLS}
  SELECT split, target = 'T0' AS is_control, count(*) AS n FROM cells GROUP BY ALL""")
def p3(spark, d):
    c = roles.cells(spark, d)
    return c.groupBy("split", (F.col("target") == CONTROL).alias("is_control")).agg(F.count("*").alias("n"))


@query("P4_members_or_control", f"""WITH {CELLS}
  SELECT target, count(*) AS n FROM cells
  WHERE target = 'T0' OR target IN (SELECT 'T' || CAST(c_custkey % 32 AS VARCHAR) FROM customer WHERE c_acctbal > 9900)
  GROUP BY 1""")
def p4(spark, d):
    from screenloom.sources.tables import read
    listed = read(spark, d, "customer", ["c_custkey", "c_acctbal"]).where("c_acctbal > 9900").select(
        F.concat(F.lit("T"), (F.col("c_custkey") % 32).cast("string")).alias("target"))
    kept = N.members_or_control(roles.cells(spark, d), listed, CONTROL)
    return kept.groupBy("target").agg(F.count("*").alias("n"))


@query("P5_min_group_size", f"WITH {CELLS}, {SIZES} SELECT split, batch, target, n_cells FROM sizes")
def p5(spark, d):
    return Screen(spark, d).sizes


@query("P6_row_magnitude", f"""WITH {EMB}
  SELECT cell_id, {rd("avg(abs(x))")} AS mean_abs, {rd("sqrt(sum(x * x))")} AS l2, {rd("max(abs(x))")} AS max_abs,
         {rd("stddev_pop(x)")} AS sd, {rd("sqrt(sum(x * x)) / sqrt(count(*))")} AS l2_scaled FROM embl GROUP BY 1""")
def p6(spark, d):
    e = roles.cell_embeddings(spark, d)
    m = e.select("cell_id", *V.magnitude("emb"), F.size("emb").alias("dim"))
    return m.select("cell_id", *[r(c, c) for c in MAG], r(F.col("l2") / F.sqrt("dim"), "l2_scaled"))


@query("P7_repair_then_clip", f"""WITH {EMB}, bad AS (
  SELECT cell_id, d, CASE WHEN d % 16 = 1 THEN NULL WHEN d % 16 = 2 THEN 1e9 WHEN d % 16 = 3 THEN -1e9 ELSE x * 60 END AS x FROM embl)
  SELECT cell_id, {rd("sum(greatest(-10, least(10, coalesce(x, 0))))")} AS total,
         CAST(sum(CASE WHEN x IS NULL OR abs(x) = 1e9 THEN 1 ELSE 0 END) AS BIGINT) AS n_repaired,
         {rd("max(greatest(-10, least(10, coalesce(x, 0))))")} AS hi
  FROM bad GROUP BY 1""")
def p7(spark, d):
    e = roles.cell_embeddings(spark, d)
    kinds = F.transform(
        "emb",
        lambda x, i: F.when(i % 16 == 0, F.lit(float("nan"))).when(i % 16 == 1, F.lit(float("inf")))
        .when(i % 16 == 2, F.lit(float("-inf"))).otherwise(x * 60),
    )
    bad = e.select("cell_id", kinds.alias("x"))
    return bad.select(
        "cell_id", V.repair_vector("x").alias("fixed"), V.count_non_finite("x").cast("bigint").alias("n_repaired")
    ).select("cell_id", r(V.vsum("fixed"), "total"), "n_repaired", r(F.array_max("fixed"), "hi"))


@query("P8_vector_helpers", f"""WITH {EMB},
  prev AS (SELECT a.cell_id, a.d, a.x, b.x AS y FROM embl a JOIN embl b ON b.cell_id = a.cell_id - 1 AND b.d = a.d)
  SELECT cell_id, {rd("sqrt(sum(x * x))")} AS norm, {rd("sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))")} AS cosine,
         {rd("sqrt(sum((x - y) * (x - y)))")} AS diff_norm, CAST(2 * count(*) AS INTEGER) AS width FROM prev GROUP BY 1""")
def p8(spark, d):
    e = roles.cell_embeddings(spark, d).select("cell_id", "emb")
    p = e.select((F.col("cell_id") + 1).alias("cell_id"), F.col("emb").alias("prev"))
    return e.join(p, "cell_id").select(
        "cell_id", r(V.norm("emb"), "norm"), r(V.cosine("emb", "prev"), "cosine"),
        r(V.norm(V.subtract("emb", "prev")), "diff_norm"), F.size(F.concat("emb", "prev")).alias("width"),
    )


@query("P9_log_count", f"WITH {CELLS}, {SIZES} SELECT split, batch, target, {rd('ln(1 + n_cells)')} AS log_n FROM sizes")
def p9(spark, d):
    return Screen(spark, d).sizes.select(*KEYS, r(F.log1p("n_cells"), "log_n"))


@query("P10_eligibility_check", f"""WITH {CELLS}, g AS (SELECT count(*) AS n FROM cells WHERE target <> 'T0' GROUP BY split, batch, target)
  SELECT 'min_cells' AS check_name, CAST(sum(CASE WHEN n < 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
         sum(CASE WHEN n < 10 THEN 1 ELSE 0 END) = 0 AS pass FROM g""")
def p10(spark, d):
    from screenloom.operators.audit import check
    s = Screen(spark, d, min_cells=1)
    return check(s.sizes, "min_cells", F.col("n_cells") < 10)


@query("P11_out_of_train_range", f"""WITH {MAGROWS},
  t AS (SELECT min(mean_abs) a1, max(mean_abs) b1, min(l2) a2, max(l2) b2, min(max_abs) a3, max(max_abs) b3, min(sd) a4, max(sd) b4
        FROM mag WHERE split = 'train')
  SELECT split, count(*) AS n, CAST(sum(CASE WHEN mean_abs < a1 OR mean_abs > b1 THEN 1 ELSE 0 END) AS BIGINT) AS mean_abs_out,
    CAST(sum(CASE WHEN l2 < a2 OR l2 > b2 THEN 1 ELSE 0 END) AS BIGINT) AS l2_out,
    CAST(sum(CASE WHEN max_abs < a3 OR max_abs > b3 THEN 1 ELSE 0 END) AS BIGINT) AS max_abs_out,
    CAST(sum(CASE WHEN sd < a4 OR sd > b4 THEN 1 ELSE 0 END) AS BIGINT) AS sd_out
  FROM mag, t GROUP BY split""")
def p11(spark, d):
    # rounded so that a train minimum is not outside its own range by the last bit of a second pass
    m = durable(magnitude_rows(Screen(spark, d)).select(*KEYS, *[F.round(c, 9).alias(c) for c in MAG]))
    return X.out_of_range(m, MAG)


@query("A1_control_mean", f"WITH {SCREEN}, {NCTRL}, {CTRL} SELECT batch, gene_idx, {rd('mean')} AS mean FROM ctrl")
def a1(spark, d):
    return Screen(spark, d, keep=False).base.select("batch", "gene_idx", r("mean", "mean"))


@query("A2_pseudobulk_mean", f"WITH {BULK} SELECT split, batch, target, gene_idx, {rd('mean')} AS mean FROM profile")
def a2(spark, d):
    return Screen(spark, d, keep=False).profile.select(*KEYS, "gene_idx", r("mean", "mean"))


@query("A3_delta_features", f"WITH {FULL} SELECT split, batch, target, gene_idx, {rd('delta')} AS delta FROM delta")
def a3(spark, d):
    return Screen(spark, d).delta.select(*KEYS, "gene_idx", r("delta", "delta"))


A4SQL = f"""{SCREEN},
  csz AS (SELECT split, target, count(*) AS n FROM cells GROUP BY ALL),
  mu AS (SELECT split, target, gene_idx, sum(v) / any_value(n) AS m FROM norm JOIN cells USING (cell_id)
         JOIN csz USING (split, target) GROUP BY split, target, gene_idx),
  xcell AS (SELECT s.split, s.target, g.gene_idx, coalesce(p.m, 0) - coalesce(c.m, 0) AS delta
    FROM (SELECT * FROM csz WHERE target <> 'T0') s CROSS JOIN (SELECT DISTINCT gene_idx FROM norm) g
    LEFT JOIN mu p ON p.split = s.split AND p.target = s.target AND p.gene_idx = g.gene_idx
    LEFT JOIN mu c ON c.split = s.split AND c.target = 'T0' AND c.gene_idx = g.gene_idx
    WHERE p.m IS NOT NULL OR c.m IS NOT NULL)"""


def construct_delta(spark, d):
    """Construct means minus the pooled control mean of the same screen (split)."""
    s = Screen(spark, d)
    keys = ["split", "target"]
    sizes = N.group_sizes(s.treated, keys)
    prof = P.means(N.treated(s.sums, CONTROL), sizes, keys)
    base = P.means(N.controls(s.sums, CONTROL), N.group_sizes(s.controls, ["split"]), ["split"])
    return P.delta(prof, sizes, base, keys, ["split"]), sizes


@query("A4_construct_delta_global_control", f"WITH {A4SQL} SELECT split, target, gene_idx, {rd('delta')} AS delta FROM xcell")
def a4(spark, d):
    return construct_delta(spark, d)[0].select("split", "target", "gene_idx", r("delta", "delta"))


def _emb_delta_sql(batch: bool) -> str:
    key = "batch, construct" if batch else "construct"
    on = "g.batch = c.batch AND g.d = c.d" if batch else "g.d = c.d"
    out = "g.batch, " if batch else ""
    return f"""WITH {EMB},
  g AS (SELECT {key}, d, avg(x) AS m, count(*) AS n FROM embl WHERE construct <> 'L0' GROUP BY ALL),
  c AS (SELECT {'batch, ' if batch else ''}d, avg(x) AS m FROM embl WHERE construct = 'L0' GROUP BY ALL)
  SELECT {out}g.construct, max(n) AS n_cells, {rd('sum(g.m - c.m)')} AS z_sum, {rd('sqrt(sum((g.m - c.m) * (g.m - c.m)))')} AS z_norm,
         {rd('max(g.m - c.m)')} AS z_max FROM g JOIN c ON {on} GROUP BY {out}g.construct"""


def _emb_delta(spark, d, scope):
    z = P.embedding_delta(roles.cell_embeddings(spark, d), "L0", scope)
    return z.select(
        *scope, "construct", "n_cells", r(V.vsum("z"), "z_sum"), r(V.norm("z"), "z_norm"), r(F.array_max("z"), "z_max")
    )


@query("A5_embedding_delta_batch_control", _emb_delta_sql(True))
def a5_batch(spark, d):
    return _emb_delta(spark, d, ["batch"])


@query("A5_embedding_delta_global_control", _emb_delta_sql(False))
def a5_global(spark, d):
    return _emb_delta(spark, d, [])


@query("A7_gene_moments", f"""WITH {BULK}, dense AS (
  SELECT g.gene_idx, coalesce(mean, 0) AS x FROM sizes s CROSS JOIN (SELECT DISTINCT gene_idx FROM profile) g
  LEFT JOIN profile p USING (split, batch, target, gene_idx))
  SELECT gene_idx, count(*) AS n, {rd('avg(x)')} AS mean, {rd('var_pop(x)')} AS var, {rd('min(x)')} AS lo, {rd('max(x)')} AS hi
  FROM dense GROUP BY 1""")
def a7(spark, d):
    s = Screen(spark, d, keep=False)
    return X.gene_stats(s.profile, s.sizes).select("gene_idx", "n", *[r(c, c) for c in ("mean", "var", "lo", "hi")])


A8SQL = f"""{BULK}, dense AS (
  SELECT batch, g.gene_idx, coalesce(mean, 0) AS x FROM (SELECT * FROM sizes WHERE split = 'train') s
  CROSS JOIN (SELECT DISTINCT gene_idx FROM profile) g LEFT JOIN profile p USING (split, batch, target, gene_idx)),
  b AS (SELECT batch, gene_idx, avg(x) AS m, CASE WHEN count(*) >= 2 THEN var_pop(x) END AS w FROM dense GROUP BY ALL),
  ratio AS (SELECT gene_idx, avg(w) AS within_var, var_pop(m) AS between_var, avg(w) / (var_pop(m) + 1e-6) AS score FROM b GROUP BY 1)"""


def _ratio(spark, d):
    s = Screen(spark, d, keep=False)
    train = F.col("split") == "train"
    return X.cross_context_ratio(s.profile.where(train), s.sizes.where(train))


@query("A8_cross_context_ratio", f"""WITH {A8SQL} SELECT gene_idx, {rd('within_var')} AS within_var,
  {rd('between_var', 8)} AS between_var, {rd('score', 3)} AS score FROM ratio""")
def a8(spark, d):
    return _ratio(spark, d).select("gene_idx", r("within", "within_var"), r("between", "between_var", 8), r("score", "score", 3))


@query("W2_top_variable_genes", f"""WITH {BULK}, dense AS (
  SELECT g.gene_idx, coalesce(mean, 0) AS x FROM (SELECT * FROM sizes WHERE split = 'train') s
  CROSS JOIN (SELECT DISTINCT gene_idx FROM profile) g LEFT JOIN profile p USING (split, batch, target, gene_idx)),
  v AS (SELECT gene_idx, var_pop(x) AS var FROM dense GROUP BY 1)
  SELECT gene_idx, {rd('var')} AS var FROM v ORDER BY v.var DESC, gene_idx LIMIT 16""")
def w2(spark, d):
    s = Screen(spark, d, keep=False)
    train = F.col("split") == "train"
    v = X.gene_stats(s.profile.where(train), s.sizes.where(train))
    return X.top_genes(v, "var", 16).select("gene_idx", r("var", "var")).orderBy("gene_idx")


WIDE = BULK.replace("CAST(l_partkey % 64 AS INTEGER)", "CAST(l_partkey AS INTEGER)")


@query("A2_pseudobulk_mean_wide", f"WITH {WIDE} SELECT split, batch, target, gene_idx, {rd('mean')} AS mean FROM profile")
def a2w(spark, d):
    """Every part is a gene."""
    return Screen(spark, d, keep=False, genes=None).profile.select(*KEYS, "gene_idx", r("mean", "mean"))


@query("P6_row_magnitude_wide", f"""WITH {FULL.replace("CAST(l_partkey % 64 AS INTEGER)", "CAST(l_partkey AS INTEGER)")}, axis AS (SELECT count(DISTINCT gene_idx) AS g FROM norm)
  SELECT split, batch, target, any_value(n_cells) AS n_cells, {rd('sum(abs(delta)) / any_value(g)')} AS mean_abs, {rd('sqrt(sum(delta * delta))')} AS l2, {rd('max(abs(delta))')} AS max_abs,
    {rd('sqrt(sum(delta * delta) / any_value(g) - pow(sum(delta) / any_value(g), 2))')} AS sd FROM delta JOIN sizes USING (split, batch, target), axis GROUP BY ALL""")
def p6w(spark, d):
    """Every part is a gene: means and deviations are over the whole axis, the genes without a delta included."""
    m = magnitude_rows(Screen(spark, d, genes=None))
    return m.select(*KEYS, "n_cells", *[r(c, c) for c in MAG])


@query("W2_top_variable_genes_wide", f"""WITH {WIDE}, n AS (SELECT count(*) AS n FROM sizes WHERE split = 'train'),
  v AS (SELECT gene_idx, (sum(mean * mean) - sum(mean) * sum(mean) / any_value(n)) / any_value(n) AS var FROM profile, n WHERE split = 'train' GROUP BY 1)
  SELECT gene_idx, {rd('var')} AS var FROM v ORDER BY round(v.var, 9) DESC, gene_idx LIMIT 2000""")
def w2w(spark, d):
    """The published 2,000 genes out of all parts."""
    s = Screen(spark, d, keep=False, genes=None)
    train = F.col("split") == "train"
    v = X.gene_stats(s.profile.where(train), s.sizes.where(train)).withColumn("rounded", F.round("var", 9))
    return X.top_genes(v, "rounded", 2000).select("gene_idx", r("var", "var"))


@query("W3_top_cross_context_genes", f"""WITH {A8SQL}
  SELECT gene_idx, {rd('score', 3)} AS score FROM ratio ORDER BY CAST(ratio.score AS FLOAT) DESC, gene_idx LIMIT 16""")
def w3(spark, d):
    scored = _ratio(spark, d).withColumn("score32", F.col("score").cast("float"))
    return X.top_genes(scored, "score32", 16).select("gene_idx", r("score", "score", 3)).orderBy("gene_idx")


A9COLS = ["mean_abs", "l2", "max_abs", "sd"]
SCALERS = ", scaler AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, var_pop({c}) AS var, count(*) AS n FROM mag WHERE split = 'train'" for c in A9COLS
) + ")"


@query("A9_train_scaler", f"""WITH {MAGROWS}{SCALERS}
  SELECT feature, {rd('mean')} AS mean, {rd('CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END')} AS scale, {rd('var')} AS var, n,
         var <= 1e-12 AS near_constant FROM scaler""")
def a9(spark, d):
    st = X.fit_scaler(magnitude_rows(Screen(spark, d)), MAG)
    return st.select("feature", r("mean", "mean"), r("scale", "scale"), r("var", "var"), "n", "near_constant")


BLOCKSQL = f"""{EMB}, eb AS (SELECT cell_id, d, x, CASE WHEN cell_id % 10 < 6 THEN 'train' WHEN cell_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM embl),
  bs AS (SELECT d, avg(x) AS u, stddev_pop(x) AS v, count(*) AS n FROM eb WHERE split = 'train' GROUP BY 1)"""


@query("A9_train_scaler_vector", f"WITH {BLOCKSQL} SELECT CAST(d - 1 AS INTEGER) AS pos, {rd('u')} AS mean, {rd('CASE WHEN v > 0 THEN v ELSE 1 END')} AS scale, n, v * v <= 1e-12 AS near_constant FROM bs")
def a9v(spark, d):
    from screenloom.plans.inference import emb_rows
    return X.fit_block_scaler(emb_rows(spark, d), "emb").select("pos", r("mean", "mean"), r("scale", "scale"), "n", "near_constant")


@query("A10_frozen_scaler_vector", f"WITH {BLOCKSQL} SELECT cell_id, split, CAST(d - 1 AS INTEGER) AS pos, {rd('(x - u) / CASE WHEN v > 0 THEN v ELSE 1 END')} AS z FROM eb JOIN bs USING (d)")
def a10v(spark, d):
    from screenloom.plans.inference import emb_rows
    e = emb_rows(spark, d)
    return X.apply_block_scaler(e, X.fit_block_scaler(e, "emb"), "emb").select("cell_id", "split", F.posexplode("emb").alias("pos", "z")).select(
        "cell_id", "split", "pos", r("z", "z"))


@query("A10_frozen_scaler_apply", f"""WITH {MAGROWS}{SCALERS},
  p AS (SELECT max(CASE WHEN feature = 'mean_abs' THEN mean END) m1, max(CASE WHEN feature = 'mean_abs' THEN sqrt(var) END) s1,
               max(CASE WHEN feature = 'l2' THEN mean END) m2, max(CASE WHEN feature = 'l2' THEN sqrt(var) END) s2,
               max(CASE WHEN feature = 'max_abs' THEN mean END) m3, max(CASE WHEN feature = 'max_abs' THEN sqrt(var) END) s3,
               max(CASE WHEN feature = 'sd' THEN mean END) m4, max(CASE WHEN feature = 'sd' THEN sqrt(var) END) s4 FROM scaler)
  SELECT split, batch, target, {rd('(mean_abs - m1) / s1')} AS mean_abs, {rd('(l2 - m2) / s2')} AS l2,
         {rd('(max_abs - m3) / s3')} AS max_abs, {rd('(sd - m4) / s4')} AS sd FROM mag, p""")
def a10(spark, d):
    # fitted and applied: the groups x genes table behind it is reduced once
    m = durable(magnitude_rows(Screen(spark, d)))
    return X.apply_scaler(m, X.fit_scaler(m, MAG), MAG).select(*KEYS, *[r(c, c) for c in MAG])


@query("A11_group_counts", f"""WITH {CELLS}, g AS (SELECT split, target, count(*) AS n FROM cells GROUP BY ALL)
  SELECT split, CAST(sum(n) AS BIGINT) AS n_cells, min(n) AS lo, {rd('quantile_cont(n, 0.5)')} AS median, max(n) AS hi FROM g GROUP BY 1""")
def a11(spark, d):
    g = roles.cells(spark, d).groupBy("split", "target").agg(F.count("*").alias("n"))
    return g.groupBy("split").agg(
        F.sum("n").alias("n_cells"), F.min("n").alias("lo"), r(F.percentile("n", F.lit(0.5)), "median"), F.max("n").alias("hi"))


@query("J5_symbol_remap_repair_clip", f"""WITH {A4SQL}, w AS (SELECT unnest(generate_series(0, 79)) AS pos)
  SELECT s.split, s.target, w.pos, w.pos < 64 AS mapped, {rd('greatest(-10, least(10, coalesce(x.delta, 0)))')} AS delta
  FROM (SELECT * FROM csz WHERE target <> 'T0') s CROSS JOIN w LEFT JOIN xcell x ON x.split = s.split AND x.target = s.target AND x.gene_idx = w.pos""")
def j5(spark, d):
    delta, sizes = construct_delta(spark, d)
    genes = roles.counts(spark, d).select("gene_idx").distinct().select(
        "gene_idx", F.concat(F.lit("G"), F.col("gene_idx").cast("string")).alias("symbol"))
    wanted = spark.range(80).select(
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("G"), F.col("id").cast("string")).alias("symbol"))
    out = X.remap(delta, sizes, genes, wanted, ["split", "target"])
    return out.select("split", "target", F.col("pos").cast("bigint").alias("pos"), "mapped", r("delta", "delta"))


@query("J5_mapped_count", "WITH n AS (SELECT DISTINCT l_partkey % 64 AS g FROM lineitem) SELECT count(*) AS n_wanted, count(n.g) AS n_mapped "
       "FROM (SELECT unnest(generate_series(0, 79)) AS pos) w LEFT JOIN n ON n.g = w.pos")
def j5n(spark, d):
    genes = roles.counts(spark, d).select("gene_idx").distinct()
    wanted = spark.range(80).select(F.col("id").cast("int").alias("gene_idx"), F.lit(1).alias("one"))
    hit = wanted.join(genes.withColumn("hit", F.lit(1)), "gene_idx", "left")
    return hit.agg(F.count("one").alias("n_wanted"), F.count("hit").alias("n_mapped"))


@query("J6_batch_baseline_join", f"""WITH {FULL}
  SELECT batch, gene_idx, count(*) AS n_groups, {rd('avg(delta)')} AS mean_delta FROM delta GROUP BY ALL""")
def j6(spark, d):
    s = Screen(spark, d)
    return s.delta.groupBy("batch", "gene_idx").agg(F.count("*").alias("n_groups"), r(F.avg("delta"), "mean_delta"))


@query("J7_global_baseline_join", f"""WITH {A4SQL}
  SELECT split, gene_idx, count(*) AS n_groups, {rd('avg(delta)')} AS mean_delta FROM xcell GROUP BY ALL""")
def j7(spark, d):
    return construct_delta(spark, d)[0].groupBy("split", "gene_idx").agg(
        F.count("*").alias("n_groups"), r(F.avg("delta"), "mean_delta"))


@query("W9_evenly_spaced_sample", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
  p AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 499.0) AS BIGINT) AS pos
        FROM (SELECT unnest(generate_series(0, 499)) AS i), (SELECT max(n) AS n FROM o))
  SELECT o_orderkey, o.pos FROM o JOIN p USING (pos)""")
def w9(spark, d):
    from screenloom.sources.tables import read
    return X.evenly_spaced(read(spark, d, "orders", ["o_orderkey"]), "o_orderkey", 500)


@query("W10_canonical_row_order", f"""WITH {CELLS}, {SIZES}
  SELECT split, batch, target, row_number() OVER (ORDER BY split, batch, target) - 1 AS row_id FROM sizes""")
def w10(spark, d):
    from screenloom.functions.ordered import ordinal
    return ordinal(Screen(spark, d).sizes.select(*KEYS), [], KEYS, "row_id").drop("row_id_n")


@query("W11_id_registry", f"""WITH {CELLS}
  SELECT target, row_number() OVER (ORDER BY late, target) - 1 AS target_id FROM (
    SELECT target, min(late) AS late FROM (
      SELECT target, 0 AS late FROM cells WHERE target <> 'T0' UNION ALL SELECT 'T0', 1) GROUP BY 1)""")
def w11(spark, d):
    c = N.treated(roles.cells(spark, d), CONTROL)
    return X.id_registry([c.where(F.col("split") == s) for s in ("train", "val", "test")], CONTROL)


def flagship(spark, d, min_cells=10, k=16):
    """Mean log1p-CP10K delta against the same batch's controls, on the k most variable genes."""
    s = Screen(spark, d, min_cells)
    train = F.col("split") == "train"
    top = X.top_genes(X.gene_stats(s.profile.where(train), s.sizes.where(train)), "var", k)
    return s.delta.join(top.select("gene_idx"), "gene_idx", "left_semi").select(*KEYS, "gene_idx", r("delta", "delta"))


@query("flagship_delta_on_top_genes", f"""WITH {FULL}, dense AS (
  SELECT g.gene_idx, coalesce(mean, 0) AS x FROM (SELECT * FROM sizes WHERE split = 'train') s
  CROSS JOIN (SELECT DISTINCT gene_idx FROM profile) g LEFT JOIN profile p USING (split, batch, target, gene_idx)),
  v AS (SELECT gene_idx, var_pop(x) AS var FROM dense GROUP BY 1),
  top AS (SELECT gene_idx FROM v ORDER BY var DESC, gene_idx LIMIT 16)
  SELECT split, batch, target, gene_idx, {rd('delta')} AS delta FROM delta WHERE gene_idx IN (SELECT gene_idx FROM top)""")
def flagship_query(spark, d):
    return flagship(spark, d)


def assembled(s: Screen, labels, listed, variants):
    """variant, keys, target_id, context_id, n_cells, y, profile for each (name, values, value, chosen genes).

    Groups whose target is not among the ``listed`` genes are left out before anything is assembled.  What all variants share is
    written once, and so is each variant."""
    listed = listed.select(F.concat(F.lit("T"), F.col("gene_idx").cast("string")).alias("target")).distinct()
    groups = durable(s.sizes.join(listed, "target", "left_semi"))
    targets = X.id_registry([s.cells.where(F.col("target") != CONTROL)], CONTROL)
    contexts = X.id_registry([s.cells.select(F.col("batch").alias("context"))], "none", "context").select(
        F.col("context").alias("batch"), F.col("target_id").alias("context_id"))
    base = durable(groups.join(targets, "target").join(contexts, "batch").join(labels, KEYS, "left"))
    out = None
    for name, values, value, chosen in variants:
        vec = durable(X.assemble(values, groups, X.positions(chosen), KEYS, value))
        one = base.join(vec, KEYS).select(F.lit(name).alias("variant"), *KEYS, "target_id", "context_id", "n_cells", "y", "profile")
        out = one if out is None else out.unionByName(one)
    return out
