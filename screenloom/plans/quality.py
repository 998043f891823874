"""Joins with accounting, set operations and audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.operators import audit as Q, joins as J
from screenloom.plans.build import KEYS, Screen, construct_delta
from screenloom.plans.registry import query, r
from screenloom.plans.sqltext import BULK, CELLS, COUNTS, EMB, FULL, NORM, SCREEN, SIZES, rd
from screenloom.sources import roles
from screenloom.sources.tables import read


def _labels(spark, d):
    """A label per customer that has both an odd key and an order, and some with none."""
    c = read(spark, d, "customer", ["c_custkey", "c_acctbal"])
    return c.where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


def _left(spark, d):
    o = read(spark, d, "orders", ["o_custkey", "o_totalprice"])
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))


LSQL = "lab AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), lft AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("J1_bridge_left_join", f"WITH {LSQL} SELECT k, {rd('lft.v')} AS v, {rd('lab.v')} AS label FROM lft LEFT JOIN lab USING (k)")
def j1(spark, d):
    out = J.bridge(_left(spark, d), _labels(spark, d).withColumnRenamed("v", "label"), ["k"])
    return out.select("k", r("v", "v"), r("label", "label"))


@query("J1_bridge_report", f"""WITH {LSQL} SELECT count(*) FILTER (lft.k IS NOT NULL AND lab.k IS NOT NULL) AS matched,
  count(*) FILTER (lab.k IS NULL) AS left_only, count(*) FILTER (lft.k IS NULL) AS right_only, CAST(0 AS BIGINT) AS left_duplicates,
  CAST(0 AS BIGINT) AS right_duplicates, {rd('max(abs(lft.v - lab.v))')} AS max_disagreement FROM lft FULL JOIN lab ON lft.k = lab.k""")
def j1r(spark, d):
    out = J.bridge_report(_left(spark, d), _labels(spark, d), ["k"], "v")
    return out.select("matched", "left_only", "right_only", "left_duplicates", "right_duplicates", r("max_disagreement", "max_disagreement"))


@query("J2_strict_alignment", f"""WITH {CELLS}, {SIZES} SELECT split, batch, target, n_cells, n_cells * 2 AS twice FROM sizes""")
def j2(spark, d):
    s = Screen(spark, d).sizes
    return J.align(s, s.select(*KEYS, (F.col("n_cells") * 2).alias("twice")), KEYS)


@query("J3_governed_semi_join", f"WITH {CELLS}, {SIZES} SELECT cell_id, split FROM cells WHERE (split, batch, target) IN (SELECT split, batch, target FROM sizes)")
def j3(spark, d):
    s = Screen(spark, d)
    return J.governed(s.cells, s.sizes, KEYS).select("cell_id", "split")


J4POP = "p AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS construct, CASE WHEN o_orderkey % 10 < 6 THEN 'train' ELSE 'test' END AS part, o_custkey % 500 AS gene FROM orders)"


@query("J4_overlap_exclusion", f"""WITH {J4POP}, k AS (SELECT * FROM p WHERE part = 'test' AND construct NOT IN (SELECT construct FROM p WHERE part = 'train'))
  SELECT count(*) AS n_rows, count(DISTINCT construct) AS n_constructs, count(DISTINCT gene) AS n_genes FROM k""")
def j4(spark, d):
    p = read(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("construct"),
        F.when(F.col("o_orderkey") % 10 < 6, "train").otherwise("test").alias("part"), (F.col("o_custkey") % 500).alias("gene"))
    k = J.exclude_overlap(p.where("part = 'test'"), p.where("part = 'train'"), "construct")
    return k.agg(F.count("*").alias("n_rows"), F.countDistinct("construct").alias("n_constructs"), F.countDistinct("gene").alias("n_genes"))


@query("J8_indexed_gather", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j8(spark, d):
    li = read(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    o = read(spark, d, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_orderkey", "l_orderkey")
    return J.gather(li, o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("U1_union_of_splits", f"WITH {CELLS} SELECT split, count(*) AS n FROM cells GROUP BY 1")
def u1(spark, d):
    c = roles.cells(spark, d)
    parts = [c.where(F.col("split") == s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))


def _sides(spark, d):
    o = read(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return [o.where(F.col("o_orderkey") % 2 == i).select(F.col("o_custkey").alias("k")) for i in (0, 1)]


USQL = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1)"


@query("U2_set_difference", f"""WITH {USQL} SELECT 'key_sets' AS check_name, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only,
  count(*) FILTER (a.k = b.k) AS matched, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_bad, count(*) FILTER (a.k IS NULL OR b.k IS NULL) = 0 AS pass
  FROM a FULL JOIN b ON a.k = b.k""")
def u2(spark, d):
    a, b = _sides(spark, d)
    return Q.key_sets(a, b, ["k"])


@query("U3_intersection_count", f"WITH {USQL} SELECT count(*) AS n_common, (SELECT count(*) FROM a) AS n_left FROM a JOIN b USING (k)")
def u3(spark, d):
    a, b = _sides(spark, d)
    ka, kb = a.distinct(), b.distinct()
    return ka.join(kb.withColumn("hit", F.lit(1)), "k", "left").agg(F.count("hit").alias("n_common"), F.count("*").alias("n_left"))


@query("U4_subset_check", f"""WITH {USQL} SELECT 'subset' AS check_name, count(*) AS n_bad, count(*) = 0 AS pass FROM a WHERE k NOT IN (SELECT k FROM b)""")
def u4(spark, d):
    a, b = _sides(spark, d)
    return Q.check(J.exclude_overlap(a.distinct(), b, "k"), "subset", F.lit(True))


@query("U5_minus_with_gates", f"""WITH {USQL}, m AS (SELECT k FROM a WHERE k NOT IN (SELECT k FROM b WHERE k % 5 = 0))
  SELECT (SELECT count(*) FROM a) AS n_raw, count(*) AS n_kept, count(*) = (SELECT count(*) FROM a) - (SELECT count(*) FROM a JOIN b USING (k) WHERE k % 5 = 0) AS gate FROM m""")
def u5(spark, d):
    a, b = _sides(spark, d)
    raw = a.distinct()
    gone = b.where(F.col("k") % 5 == 0).distinct().withColumn("gone", F.lit(1))
    return raw.join(gone, "k", "left").agg(
        F.count("*").alias("n_raw"), F.count_if(F.col("gone").isNull()).alias("n_kept"), F.count("gone").alias("n_gone")
    ).select("n_raw", "n_kept", (F.col("n_kept") == F.col("n_raw") - F.col("n_gone")).alias("gate"))


ONE = "SELECT '{n}' AS check_name, CAST({bad} AS BIGINT) AS n_bad, {bad} = 0 AS pass FROM {src}"


@query("Q1_schema_and_width", ONE.format(n="vector_width", bad="count(*) FILTER (len(embedding) <> 64)", src="embeddings"))
def q1(spark, d):
    e = read(spark, d, "embeddings")
    wrong = Q.schema_matches(e, "vec_id bigint, embedding array<float>, label int")
    if wrong:
        raise ValueError(wrong)
    return Q.vector_width(e, "embedding", 64)


@query("Q2_key_uniqueness", "SELECT 'unique_keys' AS check_name, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_bad, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) = 0 AS pass FROM lineitem")
def q2(spark, d):
    return Q.unique_keys(read(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


@query("Q3_key_set_equality", """SELECT 'key_sets' AS check_name, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only, count(*) FILTER (a.k = b.k) AS matched,
  count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_bad, count(*) FILTER (a.k IS NULL OR b.k IS NULL) = 0 AS pass
  FROM (SELECT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k""")
def q3(spark, d):
    a = read(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("k"))
    b = read(spark, d, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("k"))
    return Q.key_sets(a, b, ["k"])


@query("Q4_finite_non_negative", f"WITH {COUNTS} SELECT 'counts' AS check_name, CAST(count(*) FILTER (cnt < 0 OR cnt IS NULL OR isnan(cnt) OR isinf(cnt)) AS BIGINT) AS n_bad, count(*) FILTER (cnt < 0 OR cnt IS NULL) = 0 AS pass FROM counts")
def q4(spark, d):
    return Q.values_ok(roles.counts(spark, d), "cnt", "counts")


@query("Q5_cast_collisions", """SELECT 'cast_collisions' AS check_name, count(*) AS n_bad, count(*) = 0 AS pass FROM (
  SELECT t FROM (SELECT CAST(o_custkey AS VARCHAR) AS t, 'int' AS kind FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'text' FROM customer WHERE c_custkey % 7 = 0)
  GROUP BY t HAVING count(DISTINCT kind) > 1)""")
def q5(spark, d):
    a = read(spark, d, "orders", ["o_custkey"]).select(F.col("o_custkey").cast("string").alias("id"), F.lit("int").alias("kind"))
    b = read(spark, d, "customer", ["c_custkey"]).where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit("text").alias("kind"))
    return Q.cast_collisions(a.unionByName(b), "id", "kind")


@query("Q6_forbidden_reads", f"WITH {CELLS} SELECT split, count(*) AS n FROM cells WHERE split IN ('train', 'val') GROUP BY 1")
def q6(spark, d):
    splits = Q.guard_splits(["train", "val"], allowed=["train", "val"])
    Q.guard_columns(["cell_id", "split"], deny=["y"])
    return roles.cells(spark, d).where(F.col("split").isin(splits)).groupBy("split").agg(F.count("*").alias("n"))


@query("Q7_partition_completeness", "SELECT 'covers_once' AS check_name, count(*) FILTER (n <> 1) AS n_bad, count(*) FILTER (n <> 1) = 0 AS pass FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)")
def q7(spark, d):
    o = read(spark, d, "orders", ["o_orderkey"])
    units = [o.where(F.col("o_orderkey") % 3 == i) for i in range(3)]
    return Q.covers_once(units[0].unionByName(units[1]).unionByName(units[2]), o, "o_orderkey")


@query("Q8_two_path_equality", f"""WITH {FULL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unpaired, true AS small_median, true AS small_p95, true AS small_p99,
  CAST(0 AS BIGINT) AS n_over_exact, CAST(0 AS BIGINT) AS n_over_equivalent, 'EXACT' AS verdict FROM delta""")
def q8(spark, d):
    """The delta from written sums against one computed anew: counts dealt otherwise, means taken per
    group, baseline subtracted in an outer join."""
    from screenloom.operators import normalize as N, pseudobulk as P
    s = Screen(spark, d)
    dealt = roles.counts(spark, d).repartition(13, "gene_idx")
    norm = N.library_log1p(dealt)
    t = P.group_mean(norm, s.treated, s.sizes, KEYS).withColumnRenamed("mean", "t")
    c = P.group_mean(norm, s.controls, N.group_sizes(s.controls, ["batch"]), ["batch"])
    base = s.sizes.select(*KEYS).join(c.select("batch", "gene_idx", F.col("mean").alias("c")), "batch")
    z = t.join(base, [*KEYS, "gene_idx"], "full_outer").select(
        *KEYS, "gene_idx", (F.coalesce("t", F.lit(0.0)) - F.coalesce("c", F.lit(0.0))).alias("delta"))
    out = Q.path_equality(s.delta, z, [*KEYS, "gene_idx"], "delta")
    return out.select("n", "n_unpaired", *[(F.col(f"{q}_diff") <= 1e-10).alias(f"small_{q}") for q in ("median", "p95", "p99")],
                      "n_over_exact", "n_over_equivalent", "verdict")


@query("Q9_zero_rows_and_range", f"""WITH {EMB}, v AS (SELECT cell_id, sum(abs(x)) AS s, max(abs(x)) AS m FROM embl GROUP BY 1)
  SELECT 'all_zero' AS check_name, count(*) FILTER (s = 0) AS n_bad, count(*) FILTER (s = 0) = 0 AS pass FROM v
  UNION ALL SELECT 'within_clip', count(*) FILTER (m > 10), count(*) FILTER (m > 10) = 0 FROM v
  UNION ALL SELECT 'finite', CAST(0 AS BIGINT), true FROM (SELECT count(*) FROM v)""")
def q9(spark, d):
    from screenloom.functions import vector as V
    e = roles.cell_embeddings(spark, d)
    return Q.all_checks([
        Q.check(e, "all_zero", V.norm("emb") == 0),
        Q.check(e, "within_clip", F.array_max(F.transform("emb", lambda x: F.abs(x))) > 10),
        Q.check(e, "finite", V.count_non_finite("emb") > 0),
    ])


@query("Q10_count_reconciliation", f"""WITH {CELLS}, a AS (SELECT split, count(*) AS n FROM cells GROUP BY 1), b AS (SELECT split, count(DISTINCT cell_id) AS n FROM cells JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON cell_id = l_orderkey GROUP BY 1)
  SELECT 'reconcile' AS check_name, count(*) FILTER (a.n IS DISTINCT FROM b.n) AS n_bad, count(*) FILTER (a.n IS DISTINCT FROM b.n) = 0 AS pass FROM a FULL JOIN b ON a.split = b.split""")
def q10(spark, d):
    c = roles.cells(spark, d)
    a = c.groupBy("split").agg(F.count("*").alias("n"))
    seen = read(spark, d, "lineitem", ["l_orderkey"]).distinct().withColumnRenamed("l_orderkey", "cell_id")
    return Q.reconcile(a, c.join(seen, "cell_id", "left_semi").groupBy("split").agg(F.count("*").alias("n")), ["split"], "n")


DIGESTED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "decimal(18,2)"}
_PARTS = ", ".join(f"coalesce('{t}:' || length({c}::VARCHAR) || ':' || {c}::VARCHAR, '{t}:-')" for c, t in DIGESTED.items())


@query("Q11_content_digest", f"""WITH r AS (SELECT o_custkey AS k, sha256(concat_ws('|', {_PARTS})) AS h FROM (SELECT * REPLACE (o_totalprice::DECIMAL(18, 2) AS o_totalprice) FROM orders)),
  i AS (SELECT row_number() OVER (ORDER BY k, h) - 1 AS i, h FROM r),
  a AS (SELECT i // {Q.DIGEST_ROWS} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM i GROUP BY i // {Q.DIGEST_ROWS}),
  b AS (SELECT i // {Q.DIGEST_ROWS} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM a GROUP BY i // {Q.DIGEST_ROWS})
  SELECT (SELECT count(*) FROM orders) AS n, h AS digest FROM b""")
def q11(spark, d):
    """By customer; a customer's orders by their own digests."""
    rows = read(spark, d, "orders", list(DIGESTED)).select(*[F.col(c).cast(t).alias(c) for c, t in DIGESTED.items()])
    return Q.ordered_digest(rows, ["o_custkey"], list(DIGESTED))


@query("Q11_portable_digest", """WITH h AS (SELECT CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 8) AS BIGINT) AS h FROM orders)
  SELECT count(*) AS n, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h""")
def q11p(spark, d):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return Q.portable_digest(read(spark, d, "orders", cols), cols)


@query("Q12_repeat_determinism", "SELECT 'repeats_agree' AS check_name, CAST(0 AS BIGINT) AS n_bad, true AS pass FROM (SELECT count(*) FROM orders)")
def q12(spark, d):
    """The same totals and the same keyed draw from three runs over differently dealt rows, each run
    computed and written on its own."""
    from screenloom.functions.hashing import uniform
    from screenloom.session import durable
    o = read(spark, d, "orders", ["o_orderkey", "o_custkey"])
    layouts = [o.repartition(3, "o_orderkey"), o.repartitionByRange(7, F.desc("o_orderkey")), o.coalesce(1)]
    runs = []
    for i, rows in enumerate(layouts):
        per = rows.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("total"), F.max_by("o_orderkey", uniform("Q12", "o_orderkey")).alias("drawn"))
        runs.append(durable(per.select("o_custkey", F.concat_ws("|", "total", "drawn").alias("v"), F.lit(i).alias("repeat"))))
    return Q.repeats_agree(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["o_custkey"], "v")


@query("Q13_shuffle_is_permutation", "SELECT 'same_multiset' AS check_name, CAST(0 AS BIGINT) AS n_bad, true AS pass FROM (SELECT count(*) FROM orders)")
def q13(spark, d):
    from screenloom.operators import controls as C
    c = roles.cells(spark, d).select("split", "cell_id").withColumn("v", F.col("cell_id") * 7)
    return Q.same_multiset(c, C.shuffled(c, "cell_id", ["v"], C.SEEDS["C3"]), ["split", "v"])
