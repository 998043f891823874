"""Sizes beyond former limits, layouts, and workers without the package."""
import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from screenloom.functions import sizes
from screenloom.operators import blocks, features as X, linear as L, metrics as M, pairs as P, resample as B
from screenloom.plans import evaluation as E
from screenloom.session import durable


def test_remap_takes_a_long_list(spark):
    n = 200_001
    wanted = spark.range(n).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("g"), "id").alias("symbol"))
    genes = spark.createDataFrame([(7, "g3"), (5, "g3"), (9, "g200000")], "gene_idx int, symbol string")
    values = spark.createDataFrame([("a", 5, 1.5), ("a", 9, 50.0)], "t string, gene_idx int, delta double")
    out = X.remap(values, values.select("t").distinct(), genes, wanted, ["t"])
    assert out.count() == n
    assert {r["pos"]: r["delta"] for r in out.where("delta <> 0").collect()} == {3: 1.5, 200_000: 10.0}


def test_nearest_pairs_break_ties_by_key(spark):
    rows = [("a", 10, 5.0), ("a", 11, 6.5), ("a", 12, 9.0), *[("b", i, 5.0) for i in (3, 1, 2)], ("b", 4, 8.0), ("b", 0, 8.0)]
    df = spark.createDataFrame(rows, "ctx string, row int, u double")
    none = spark.createDataFrame([], "ctx_a string, ctx_b string")
    for k in (1, 2, 3):
        want = set()
        for c, i, u in rows[:3]:
            near = sorted((abs(u - v), j) for _, j, v in rows[3:])[:k]
            want |= {(i, j) for _, j in near}
        for limit in (None, 0):
            got = P.tier3(df, "ctx", "row", "u", none, k, limit).collect()
            assert {(r["row_a"], r["row_b"]) for r in got} == want and len(got) == 3 * k


def test_nearest_vectors_do_not_depend_on_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(c, i, [float(x) for x in 1e4 + rng.standard_normal(6)]) for i, c in enumerate("ab" * 40)]
    df = spark.createDataFrame(rows, "ctx string, row int, v array<double>")
    seen = []
    for size in (8, 64, 512):
        seen.append(sorted(map(tuple, blocks.nearest(df, "ctx", "row", "v", 2, size=size).collect())))
    assert seen[0] == seen[1] == seen[2]


def test_hot_cluster_of_equal_values_is_split(spark, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 10)
    rows = [(i, "hot", 1.0, 2.0) for i in range(100)] + [(100 + i, f"c{i % 5}", float(i), float(i * i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, c string, y double, p double")
    cut = sorted(B.cluster_bootstrap_rho(df, "c", "y", {"o": ["p"]}, 3, 1, key="k").collect())
    monkeypatch.setattr(B, "PART_ROWS", 1000)
    assert np.allclose([r[1] for r in cut], [r[1] for r in sorted(B.cluster_bootstrap_rho(df, "c", "y", {"o": ["p"]}, 3, 1, key="k").collect())])


def test_broadcast_goes_by_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array_repeat(F.lit(1.0), 100).alias("a"), "id")
    assert 10 * 1800 <= sizes.measured_bytes(wide) <= 10 * 2000
    assert not sizes.small(wide, 10_000) and sizes.small(wide, 40_000)
    assert sizes.measured_bytes(wide.where("false")) == 0


def test_stored_tables_prune_columns(spark):
    kept = durable(spark.range(100).select("id", F.md5(F.col("id").cast("string")).alias("h")))
    plan = kept.select("id").where("id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "PushedFilters" in plan


def test_block_scaler_uses_training_rows_only(spark):
    rng = np.random.default_rng(1)
    train, val = rng.standard_normal((400, 5)) * 3 + 5, rng.standard_normal((200, 5)) * 7 - 2
    train[:, 4] = val[:, 4] = 2.0
    rows = [("train", [float(x) for x in v]) for v in train] + [("val", [float(x) for x in v]) for v in val]
    df = spark.createDataFrame(rows, "split string, v array<double>")
    stats = X.fit_block_scaler(df, "v")
    out = X.apply_block_scaler(df, stats, "v").collect()
    a, b = (np.array([r["v"] for r in out if r["split"] == s]) for s in ("train", "val"))
    assert np.allclose(a.mean(0), 0, atol=1e-9) and np.allclose(a.std(0)[:4], 1) and np.allclose(a[:, 4], 0)
    assert np.allclose(b, (val - train.mean(0)) / np.where(train.std(0) > 1e-9, train.std(0), 1))
    assert [r["near_constant"] for r in stats.orderBy("pos").collect()] == [False] * 4 + [True]


def test_ridge_on_vectors_equals_direct(spark):
    rng = np.random.default_rng(2)
    x, s = rng.standard_normal((80, 6)), rng.standard_normal(80)
    y = x @ rng.standard_normal(6) + s + 0.1 * rng.standard_normal(80)
    df = spark.createDataFrame([([float(u) for u in a], float(b), float(c)) for a, b, c in zip(x, s, y)], "v array<double>, s double, y double")
    got = np.array([r["prediction"] for r in L.fit_linear(df, ["v", "s"], "y", 3.0).transform(df).collect()])
    z = np.column_stack([x, s])
    zc = z - z.mean(0)
    w = np.linalg.solve(zc.T @ zc + 3 * np.eye(7), zc.T @ (y - y.mean()))
    assert np.allclose(got, y.mean() + zc @ w, atol=1e-6)


def test_one_class_has_no_separability(spark):
    df = spark.createDataFrame([(i, "only", [float(i), 1.0]) for i in range(20)], "i int, c string, v array<double>")
    assert L.separability(df, "i", "v", "c").first()["accuracy"] is None


def test_tests_carry_the_digest_of_the_choice(spark):
    rows = [(a, f, s, sp, i, float(i), i + (0.1 if f == "x" else 3.0)) for a in "ab" for f in "xy" for s in (0, 1) for sp in ("val", "test") for i in range(6)]
    scores = spark.createDataFrame(rows, "arm string, family string, seed int, split string, key int, y double, yhat double")
    frozen = E.freeze(E.validation_table(scores.where("split = 'val'")))
    tested = E.test_table(frozen, scores)
    assert {(r["arm"], r["family"], r["frozen"]) for r in tested.collect()} == {("a", "x", frozen.content()), ("b", "x", frozen.content())}
    other = E.freeze(E.validation_table(scores.where("split = 'val' AND family = 'y'")))
    assert other.content() != frozen.content()


def test_density_weighted_error(spark):
    table = spark.createDataFrame([(0, 0.0, 2.0), (1, 1.0, 5.0)], "bin int, left_edge double, weight double")
    rows = spark.createDataFrame([(0.5, 0.0), (1.0, 0.0), (1.5, 0.0), (9.0, 8.0), (-3.0, -3.0)], "y double, p double")
    got = M.density_weighted_error(rows, table, "y", "p").first()["weighted_mse"]
    # 1.0 lies on the inner edge and belongs to the lower bin
    assert abs(got - (2 * 0.25 + 2 * 1.0 + 5 * 2.25 + 5 * 1.0) / (2 + 2 + 5 + 5 + 2)) < 1e-12


def test_overall_verdict(spark):
    gate = lambda *p: spark.createDataFrame([(i, x) for i, x in enumerate(p)], "item int, pass boolean")
    assert E.overall(gate(True, True)).first()["pass"] and not E.overall(gate(True, False)).first()["pass"]
    assert not E.overall(gate(True).where("false")).first()["pass"]


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from screenloom.plans.catalog import QUERIES
from screenloom.session import local_session
spark = local_session(2)
sys.path.remove({root!r})
print("rows", QUERIES["A16_gram"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from a folder from which the workers cannot import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_blocks_travel_once_for_each_part(spark, monkeypatch):
    """With ten times the blocks a row is sent as often, and every pair of blocks meets once."""
    import pyarrow as pa

    monkeypatch.setattr(blocks, "PARTS", 4)

    def count(table, met):
        return pa.table({"rows": [sum(len(v) for v in table["vecs"])], "pairs": [len(met)]})

    for n in (32, 320):
        df = spark.range(n).selectExpr("id % 3 AS c", "id", "array(CAST(id AS double)) AS v")
        packed = blocks.pack(df, "c", "id", "v", 2)
        held, met = blocks.meet(packed, True, count, "rows bigint, pairs bigint").groupBy().sum().first()
        k = packed.count()
        assert held <= 4 * n and met == k * (k + 1) // 2


def test_cluster_bootstrap_by_strips_equals_whole(spark, monkeypatch):
    """Ties across and inside strips, nulls: the same correlations as from all rows in a task, and no rows x replicates are moved."""
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 17) ** 2, float(rng.integers(0, 25)), None if i % 31 == 0 else float(rng.integers(0, 9)), float(rng.normal())) for i in range(230)]
    df = spark.createDataFrame(rows, "k int, c int, y double, p double, q double")
    objects = {"o": ["p"], "b": ["p", "q"]}
    whole = sorted(B.cluster_bootstrap_rho(df, "c", "y", objects, 12, 5).collect())
    monkeypatch.setattr(B, "PART_ROWS", 40)
    cut = B.cluster_bootstrap_rho(df, "c", "y", objects, 12, 5, limit=0)
    assert np.allclose([r[1:] for r in sorted(cut.collect())], [r[1:] for r in whole])
    # sums for pairs of strips are written, no row for a draw
    written = spark.read.parquet(*cut.inputFiles())
    assert {"kind", "i", "j", "ab"} <= set(written.columns) and written.count() <= 12 * 2 * (6 * 6 + 2 * 6)


def test_strips_are_not_copied_for_every_core(spark, monkeypatch):
    """Rows travel packed, and no more copies of them than ``MOVED`` bytes allow, however many tasks the session wants; ranks go piece by piece."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 40)), float(rng.integers(0, 90)), float(rng.normal()), float(rng.integers(0, 6))) for _ in range(400)]
    df = spark.createDataFrame(rows + rows[:50], "c int, y double, p double, q double")
    whole = sorted(B.cluster_bootstrap_rho(df, "c", "y", {"p": ["p"], "q": ["q"]}, 21, 5).collect())
    asked = []

    def written(x):
        if "kind" in x.columns:
            asked.append(x.rdd.getNumPartitions())
        return durable(x)

    monkeypatch.setattr(B, "durable", written)
    monkeypatch.setattr(B, "PIECE", 7, raising=False)
    for strip, moved, tasks in ((1000, 1, 2), (1000, 3 * 450 * 16 * 2, 2 * 3), (200, 1, 3 * 3 * 2)):
        monkeypatch.setattr(B, "PART_ROWS", strip)
        monkeypatch.setattr(B, "MOVED", moved, raising=False)
        cut = sorted(B.cluster_bootstrap_rho(df, "c", "y", {"p": ["p"], "q": ["q"]}, 21, 5, limit=0).collect())
        assert np.allclose([r[1:] for r in cut], [r[1:] for r in whole], rtol=1e-9)
        assert asked.pop() == tasks


def test_counts_get_more_tasks_with_more_entries(spark, monkeypatch):
    from screenloom.sources import roles

    few = roles.counts(spark, "/root/testdata/sf0.001")
    want = sorted(few.collect())
    monkeypatch.setattr(roles, "ENTRIES_IN_TASK", 200, raising=False)
    many = roles.counts(spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() == 30 and sorted(many.collect()) == want


def test_variants_of_assembled_profiles_share_written_stages(spark):
    from screenloom.plans.build import KEYS, Screen, assembled

    s = Screen(spark, "/root/testdata/sf0.001", min_cells=3)
    chosen = s.profile.select("gene_idx").distinct()
    labels = s.sizes.select(*KEYS, F.lit(0.5).alias("y"))
    listed = spark.range(64).select(F.col("id").alias("gene_idx"))
    out = assembled(s, labels, listed, [("a", s.profile, "mean", chosen), ("b", s.delta, "delta", chosen)])
    # no variant reads the given tables again
    assert out.count() == 2 * s.sizes.count() and not any(f"{t}.parquet" in x for t in ("orders", "lineitem") for x in out.inputFiles())


def test_wide_sums_and_deltas_have_more_tasks_as_entries_grow(spark, monkeypatch):
    from screenloom.plans.build import Screen
    from screenloom.sources import roles

    d = "/root/testdata/sf0.001"
    key = lambda df: {tuple(r[:4]): round(r[4], 9) for r in df.collect()}
    want = key(Screen(spark, d, 3, genes=None).delta)
    monkeypatch.setattr(roles, "ENTRIES_IN_TASK", 200)
    s = Screen(spark, d, 3, keep=False, genes=None)
    assert s.sums.rdd.getNumPartitions() >= roles.entries(spark, d) // 200 > 8
    assert s.delta.rdd.getNumPartitions() > s.sums.rdd.getNumPartitions()
    assert key(s.delta) == want


def test_no_row_of_a_baseline_grows_with_the_genes(spark, monkeypatch):
    """A large baseline is dealt by gene and meets the groups there; beside many groups it travels in bounded arrays."""
    from screenloom.operators import pseudobulk as PB
    from screenloom.plans.build import Screen
    from screenloom.sources import roles

    groups = spark.createDataFrame([("train", "a", "T1"), ("val", "a", "T1"), ("train", "b", "T2"), ("train", None, "T3"), ("train", "d", "T2")], "split string, batch string, target string")
    base = spark.createDataFrame([("a", g, g / 7) for g in range(50)] + [("b", 3, 1.5), ("c", 4, 2.5), (None, 5, 1.0)], "batch string, gene_idx int, mean double")
    profile = groups.select("*", F.lit(3).alias("gene_idx"), F.lit(2.0).alias("mean"))
    keys, key = ["split", "batch", "target"], lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = key(PB.delta(profile, groups, base, keys, ["batch"]))
    assert len(want) == 50 + 50 + 1 + 2 and sum(r[:3] == ("train", "b", "T2") for r in want) == 1
    monkeypatch.setattr(PB, "small", lambda df, *most: "mean" not in df.columns and "_genes" not in df.columns)
    dealt = PB.delta(profile, groups, base, keys, ["batch"], [30])
    assert "collect_list" not in dealt._jdf.queryExecution().toString() and key(dealt) == want
    monkeypatch.setattr(PB, "small", lambda df, *most: False)
    monkeypatch.setattr(PB, "GENES_IN_ARRAY", 7, raising=False)
    assert key(PB.delta(profile, groups, base, keys, ["batch"])) == want
    # written sums are dealt anew before they are added up
    monkeypatch.setattr(roles, "ENTRIES_IN_TASK", 200)
    d = "/root/testdata/sf0.001"
    assert Screen(spark, d, 3, genes=None).profile.rdd.getNumPartitions() >= roles.entries(spark, d) // 200


def test_median_distance_takes_two_sweeps_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((900, 5)) * np.r_[np.ones(600), np.full(300, 1.2)][:, None]
    df = spark.createDataFrame([("ab"[i >= 600], i, [float(z) for z in v]) for i, v in enumerate(x)], "ctx string, row int, v array<double>")
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    want = np.median(d2[np.triu_indices(900, 1)])
    packed = blocks.pack(df, "ctx", "row", "v", 32)
    sweeps, meet = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda b, *more: sweeps.append(b.count()) or meet(b, *more))
    assert np.isclose(blocks.median_sq_distance(packed, True).first()["med"], want, rtol=1e-12)
    assert sweeps.count(packed.count()) == 2
    # a guess beside the middle, below and above it, costs a sweep but no result
    for wrong in ((0, 1), (blocks.BINS - 2, blocks.BINS - 1)):
        monkeypatch.setattr(blocks, "_guess", lambda *_: wrong)
        assert np.isclose(blocks.median_sq_distance(packed, True).first()["med"], want, rtol=1e-12)
    own = {r["pa"]: r["med"] for r in blocks.median_sq_distance(packed, False).collect()}
    assert np.isclose(own["a"], np.median(d2[:600, :600][np.triu_indices(600, 1)]), rtol=1e-12)


def test_a_sweep_runs_once(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([("abc"[i % 3], i, [float(z) for z in rng.standard_normal(4)]) for i in range(60)], "ctx string, row int, v array<double>")
    seen = spark.sparkContext.accumulator(0)
    packed = blocks.pack(df, "ctx", "row", "v", 8)

    def count(d, want):
        seen.add(len(d))
        return [(np.zeros(1, np.int64), np.zeros(1), np.array([len(d)]))]

    pairs = blocks.context_pairs(packed, "ctx").withColumnsRenamed({"ctx_a": "pa", "ctx_b": "pb"})
    got = blocks._sweep(packed, True, count, pairs).collect()
    assert sorted(r["n"] for r in got) == [780] * 3 and seen.value == 60 * 59 // 2


def test_later_blocks_give_few_candidates(spark):
    rng = np.random.default_rng(13)
    x, y, z = (rng.standard_normal((n, 6)) for n in (300, 700, 700))
    first = blocks._best(*blocks._nearest(x, y, 3), 3)
    known = blocks._farthest(first, 300, 3)
    row, col, d2 = blocks._nearest(x, z, 3, known)
    assert len(row) < 300 * 6
    got = blocks._best(*(np.concatenate(p) for p in zip(first, (row, col + 700, d2))), 3)
    whole = ((x[:, None] - np.concatenate([y, z])[None]) ** 2).sum(2)
    assert np.array_equal(got[1].reshape(300, 3), np.argsort(whole, axis=1, kind="stable")[:, :3])
    # fewer rows than wanted bound nothing
    assert np.isinf(blocks._farthest(blocks._best(*blocks._nearest(x, y[:2], 3), 3), 300, 3)).all()
