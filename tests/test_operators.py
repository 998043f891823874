"""Rules and edge cases on small frames."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from screenloom.functions import ordered as O, vector as V
from screenloom.operators import audit as Q, blocks as K, controls as C, endpoint as E, features as X, joins as J
from screenloom.functions import draws
from screenloom.operators import linear as L, metrics as M, normalize as N, pairs as P, pseudobulk as PB, resample as B
from screenloom.plans import evaluation as EV
from screenloom.sources import tables, variants

RNG = np.random.default_rng(5)


def frame(spark, cols, **arrays):
    rows = list(zip(*[[x.item() if hasattr(x, "item") else x for x in arrays[c]] for c in arrays]))
    return spark.createDataFrame(rows, cols)


def test_published_four_sample_example():
    labs = [
        [38.7, 41.5, 43.8, 44.5, 45.5, 46.0, 47.7, 58.0], [39.2, 39.3, 39.7, 41.4, 41.8, 42.9, 43.3, 45.8],
        [34.0, 35.0, 39.0, 40.0, 43.0, 43.0, 44.0, 45.0], [34.0, 34.8, 34.8, 35.4, 37.2, 37.8, 41.2, 42.8],
    ]
    assert abs(brute.anderson([np.array(x) for x in labs]) - 4.480) < 5e-4


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("n1,n2", [(12, 30), (5, 4), (60, 75)])
def test_anderson_darling_equals_direct_sum(spark, n1, n2, limit):
    a, b = RNG.integers(0, 6, n1) / 2.0, RNG.integers(1, 9, n2) / 2.0
    vals = sorted(set(a) | set(b))
    hist = spark.createDataFrame(
        [("g", float(v), int((a == v).sum()), int((b == v).sum())) for v in vals], "k string, value double, f1 bigint, f2 bigint")
    row = E.anderson_darling(hist, ["k"], limit).first()
    want = brute.anderson([a, b])
    assert abs(row["stat"] - want) < 1e-9
    assert abs(row["y"] - math.log1p(max(0.0, want))) < 1e-9


def test_anderson_darling_undefined_groups_are_dropped(spark):
    hist = spark.createDataFrame(
        [("one value", 1.0, 5, 5), ("lone", 1.0, 1, 3), ("lone", 2.0, 0, 3), ("ok", 1.0, 3, 1), ("ok", 2.0, 1, 3)],
        "k string, value double, f1 bigint, f2 bigint")
    assert [r["k"] for r in E.anderson_darling(hist, ["k"]).collect()] == ["ok"]


def test_zero_total_cell_counts_as_zeros(spark):
    counts = spark.createDataFrame([(1, 0, 0.0), (2, 0, 4.0), (2, 1, 4.0)], "cell_id bigint, gene_idx int, cnt double")
    cells = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "cell_id bigint, target string")
    norm = N.library_log1p(counts)
    assert norm.where("cell_id = 1").first()["v"] == 0.0
    m = PB.group_mean(norm, cells, N.group_sizes(cells, ["target"]), ["target"])
    got = {r["gene_idx"]: r["mean"] for r in m.collect()}
    assert got == pytest.approx({0: math.log1p(5000) / 3, 1: math.log1p(5000) / 3})


def test_library_floor_differs_from_zero_guard(spark):
    counts = spark.createDataFrame([(1, 0, 0.5)], "cell_id bigint, gene_idx int, cnt double")
    assert N.library_log1p(counts).first()["v"] == pytest.approx(math.log1p(1e4))
    assert N.library_log1p(counts, floor=1.0).first()["v"] == pytest.approx(math.log1p(5e3))


def test_delta_has_genes_of_either_side(spark):
    prof = spark.createDataFrame([("b", "A", 0, 2.0)], "batch string, target string, gene_idx int, mean double")
    base = spark.createDataFrame([("b", 0, 0.5), ("b", 1, 1.5)], "batch string, gene_idx int, mean double")
    sizes = spark.createDataFrame([("b", "A", 10)], "batch string, target string, n_cells bigint")
    got = {r["gene_idx"]: r["delta"] for r in PB.delta(prof, sizes, base, ["batch", "target"], ["batch"]).collect()}
    assert got == {0: 1.5, 1: -1.5}


def test_large_baseline_is_salted_not_broadcast(spark, monkeypatch):
    prof = spark.createDataFrame([("b", f"A{i}", 0, 2.0) for i in range(9)], "batch string, target string, gene_idx int, mean double")
    base = spark.createDataFrame([("b", g, 0.5) for g in range(5)], "batch string, gene_idx int, mean double")
    sizes = prof.select("batch", "target").withColumn("n_cells", F.lit(10))
    whole = sorted(PB.delta(prof, sizes, base, ["batch", "target"], ["batch"]).collect())
    monkeypatch.setattr(PB, "small", lambda df: False)
    salted = PB.delta(prof, sizes, base, ["batch", "target"], ["batch"])
    assert sorted(salted.collect()) == whole and len(whole) == 45


def test_magnitude_norm_is_not_divided(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(*V.magnitude("x")).first()
    assert row["l2"] == pytest.approx(math.sqrt(14)) and row["sd"] == pytest.approx(np.std([1, 2, 3]))


def test_repair_clips_last(spark):
    x = [float("nan"), float("inf"), float("-inf"), 11.0, -3.0]
    row = spark.createDataFrame([(x,)], "x array<double>").select(V.repair_vector("x").alias("v"), V.count_non_finite("x").alias("n")).first()
    assert row["v"] == [0.0, 10.0, -10.0, 10.0, -3.0] and row["n"] == 3


def test_range_path_equals_window_path(spark):
    n = 500
    df = frame(spark, ["k", "v", "i"], k=RNG.integers(0, 3, n), v=RNG.integers(0, 40, n) / 4, i=np.arange(n))
    for fn in (
        lambda lim: O.average_rank(df, ["k"], {"r": "v"}, lim),
        lambda lim: O.ordinal(df, ["k"], ["v", "i"], "p", lim),
        lambda lim: O.weighted_rank(df.withColumn("w", F.col("i") % 4), ["k"], "v", "w", "r", lim),
        lambda lim: O.ordinal(df, [], ["i"], "p", lim),
    ):
        a, b = fn(None), fn(0)
        assert sorted(a.select(sorted(a.columns)).collect()) == sorted(b.select(sorted(a.columns)).collect())


def test_quantiles_by_rank_equal_numpy(spark):
    v = RNG.integers(0, 9, 101) / 3
    df = frame(spark, ["k", "v"], k=[1] * 101, v=v)
    for lim in (None, 0):
        got = X.quantiles_by_rank(df, "v", [0.0, 0.025, 0.2, 0.5, 1.0], ["k"], lim).first()["edges"]
        assert got == pytest.approx(list(np.quantile(v, [0.0, 0.025, 0.2, 0.5, 1.0])))


def test_alpha_ties_and_non_finite(spark):
    nan, inf = float("nan"), float("inf")
    grids = {"tie": [.1, .42, .2, .42, .3, .42, .05], "mixed": [nan, .5, inf, .7, -inf, .6, nan], "none": [nan, inf, -inf, nan, nan, inf, nan]}
    rows = [(k, a, s) for k, v in grids.items() for a, s in zip(L.ALPHAS, v)]
    got = {r["k"]: r for r in M.select_alpha(spark.createDataFrame(rows, "k string, alpha double, r2 double"), ["k"]).collect()}
    assert got["tie"]["selected_alpha"] == 100.0 and got["tie"]["tie_applied"]
    assert got["mixed"]["selected_alpha"] == 1.0 and not got["mixed"]["tie_applied"]
    assert got["none"]["selected_alpha"] is None and got["none"]["status"] == "PROBE_DEGENERATE"


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("one", 5.0, 1.0)], "k string, y double, p double")
    from screenloom.functions import stats as S
    for r in df.groupBy("k").agg(S.r2("y", "p").alias("r2"), S.pearson("y", "p").alias("r")).collect():
        assert r["r2"] is None and r["r"] is None


def test_negative_variance_component_is_kept(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 0.0), ("b", 2.0)], "g string, t double").withColumn("s", F.lit("x"))
    v = E.variance_components(df, "t", ["g"], ["s"]).first()
    assert v["icc"] == pytest.approx(-1.0) and v["var_between"] < 0
    assert v["ssb"] + v["ssw"] == pytest.approx(v["total_ss"])
    assert v["approx_n_arith"] is None and v["interpretable_arith"] is False


def test_scaler_fits_on_training_rows_only(spark):
    tr, va = RNG.normal(5, 3, 400), RNG.normal(-2, 7, 200)
    df = frame(spark, ["split", "a"], s=["train"] * 400 + ["val"] * 200, a=np.concatenate([tr, va])).withColumn("b", F.lit(3.0))
    st = X.fit_scaler(df, ["a", "b"])
    out = X.apply_scaler(df, st, ["a", "b"]).groupBy("split").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("b").alias("b")).collect()
    got = {r["split"]: r for r in out}
    assert abs(got["train"]["m"]) < 1e-9 and got["train"]["s"] == pytest.approx(1.0) and got["train"]["b"] == 0.0
    assert got["val"]["m"] == pytest.approx((va.mean() - tr.mean()) / tr.std())
    assert {r["feature"]: r["near_constant"] for r in st.collect()} == {"a": False, "b": True}


def test_first_symbol_wins_and_missing_is_zero(spark):
    vals = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 99.0)], "t string, gene_idx int, delta double")
    genes = spark.createDataFrame([(0, "X"), (1, "Y"), (2, "X")], "gene_idx int, symbol string")
    want = spark.createDataFrame([(0, "Y"), (1, "X"), (2, "Z")], "pos int, symbol string")
    out = X.remap(vals, vals.select("t").distinct(), genes, want, ["t"]).orderBy("pos").collect()
    assert [(r["delta"], r["mapped"]) for r in out] == [(10.0, True), (1.0, True), (0.0, False)]


def test_shuffle_is_a_permutation_within_split(spark):
    df = spark.range(313).select(F.col("id").alias("k"), F.when(F.col("id") < 200, "train").otherwise("test").alias("split"), F.col("id").alias("v"))
    for lim in (None, 0):
        out = C.shuffled(df, "k", ["v"], 1, limit=lim)
        got = out.collect()
        assert sorted(r["v"] for r in got) == list(range(313)) and any(r["v"] != r["k"] for r in got)
        assert all((r["v"] < 200) == (r["split"] == "train") for r in got)


def test_unknown_split_fails(spark):
    with pytest.raises(Exception, match="unknown split"):
        spark.createDataFrame([(1, "holdout")], "k bigint, split string").select(C.noise("k", 2, 1)).collect()


def test_controls_take_no_label():
    import inspect
    for fn in (C.noise, C.projection_matrix, C.project, C.shuffled):
        assert not {"y", "label"} & set(inspect.signature(fn).parameters)


def test_noise_is_standard_normal(spark):
    n = 20000
    x = np.array([r["x"] for r in spark.range(n).select(F.lit("val").alias("split"), "id").select(C.noise("id", 4, 7).alias("x")).collect()])
    five_sd = 5 / math.sqrt(n)
    assert abs(x.mean()) < five_sd and abs(x.std() - 1) < five_sd
    assert abs(np.corrcoef(x.T) - np.eye(4)).max() < five_sd


def test_row_bootstrap_equals_direct_resample(spark):
    n = 80
    y, a, b = RNG.normal(size=n), RNG.normal(size=n), RNG.normal(size=n)
    df = frame(spark, ["k", "y", "a", "b"], k=np.arange(n), y=y, a=a, b=b)
    for lim in (None, 0):
        boot = {r["rep"]: r["delta"] for r in B.row_bootstrap_delta_r2(df, "k", "y", ["a"], ["b"], 5, 3, lim).collect()}
        for rep in range(1, 6):
            i = np.repeat(np.arange(n), draws.multiplicities(3, rep, n))
            assert len(i) == n and boot[rep] == pytest.approx(brute.r2(y[i], a[i]) - brute.r2(y[i], b[i]))


def test_cluster_bootstrap_recomputes_ranks(spark):
    n = 150
    cl, y = RNG.integers(0, 30, n), RNG.integers(0, 20, n) / 1.0
    p = [RNG.normal(size=n).round(1) for _ in range(3)]
    ids = sorted(set(cl.tolist()))
    df = frame(spark, ["c", "y", "p0", "p1", "p2"], c=cl, y=y, p0=p[0], p1=p[1], p2=p[2])
    for lim in (None, 0):
        boot = {r["rep"]: r for r in B.cluster_bootstrap_rho(df, "c", "y", {"u": ["p0", "p1"], "v": ["p2"]}, 4, 9, lim).collect()}
        for rep in range(1, 5):
            w = draws.multiplicities(9, rep, len(ids))
            i = np.concatenate([np.where(cl == ids[h])[0] for h in np.repeat(np.arange(len(ids)), w)])
            rho = [brute.spearman(y[i], q[i]) for q in p]
            assert boot[rep]["u"] == pytest.approx((rho[0] + rho[1]) / 2) and boot[rep]["v"] == pytest.approx(rho[2])


def test_row_bootstrap_in_blocks(spark):
    """Many blocks: the halving tree deals all draws, and each replicate equals its direct resample."""
    n, size = 103, 10
    y, a, b = RNG.normal(size=n), RNG.normal(size=n), RNG.normal(size=n)
    df = frame(spark, ["k", "y", "a", "b"], k=np.arange(n), y=y, a=a, b=b)
    boot = {r["rep"]: r["delta"] for r in B.row_bootstrap_delta_r2(df, "k", "y", ["a"], ["b"], 6, 3, block=size).collect()}
    assert sorted(boot) == list(range(1, 7))
    for rep in boot:
        w = np.concatenate([draws.multiplicities(3, rep, n, blk, size) for blk in range(11)])
        i = np.repeat(np.arange(n), w)
        assert len(w) == len(i) == n and boot[rep] == pytest.approx(brute.r2(y[i], a[i]) - brute.r2(y[i], b[i]))


def test_multiplicities_are_multinomial():
    for n, size in ((40, 40), (40, 7)):
        w = np.array([np.concatenate([draws.multiplicities(1, rep, n, blk, size) for blk in range(-(-n // size))]) for rep in range(4000)])
        assert (w.sum(axis=1) == n).all()
        assert abs(w.mean(axis=0) - 1).max() < 0.09 and abs(w.var(axis=0) - (1 - 1 / n)).max() < 0.2
        assert abs(np.corrcoef(w.T)[0, 1:] + 1 / (n - 1)).max() < 0.08


def test_row_bootstrap_of_odd_rows(spark):
    """A null prediction is left out of the error, a resample of one value is undefined, no rows give no replicates."""
    df = spark.createDataFrame([(1, 5.0, 5.0, None), (2, 5.0, 4.0, None)], "k int, y double, a double, b double")
    out = B.row_bootstrap_delta_r2(df, "k", "y", ["a"], ["b"], 20).collect()
    assert len(out) == 20 and all(r["delta"] is None for r in out)
    assert B.row_bootstrap_delta_r2(df.where("false"), "k", "y", ["a"], ["b"], 20).collect() == []


def test_bootstrap_summary_counts_undefined(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (-0.2,), (None,)], "delta double")
    r = B.summarize(df).first()
    assert r["n"] == 3 and r["n_skipped"] == 1 and r["median"] == pytest.approx(0.1) and r["sign_stab"] == pytest.approx(2 / 3)


def test_matched_cells_drop_short_groups(spark):
    cells = spark.range(40).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 30, "A").otherwise("B").alias("g"))
    out = B.matched_cells(cells, ["g"], 12, [1, 2]).collect()
    assert len(out) == 24 and {r["g"] for r in out} == {"A"}
    assert len({r["cell_id"] for r in out if r["seed"] == 1}) == 12


def test_folds_have_array_split_sizes(spark):
    df = spark.range(33).select("id", (F.col("id") % 2).alias("c"))
    for lim in (None, 0):
        sizes = {(r["c"], r["fold"]): r["n"] for r in B.stratified_folds(df, "c", "id", 5, 0, lim).groupBy("c", "fold").agg(F.count("*").alias("n")).collect()}
        assert [sizes[(0, i)] for i in range(5)] == [4, 4, 3, 3, 3] and [sizes[(1, i)] for i in range(5)] == [4, 3, 3, 3, 3]


@pytest.mark.parametrize("limit", [None, 0])
def test_order_agreement_equals_all_pairs(spark, limit):
    a, b = RNG.integers(0, 12, 90) / 1.0, RNG.integers(0, 12, 90) / 1.0
    df = frame(spark, ["k", "a", "b"], k=[1] * 90, a=a, b=b)
    assert P.order_agreement(df, ["k"], "a", "b", limit).first()["agreement"] == pytest.approx(brute.agreement(a, b))


def test_order_agreement_by_strips_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "ORDERED_IN_TASK", 20)
    n = 400
    a, b = RNG.integers(0, 60, n) / 1.0, RNG.normal(size=n).round(1)
    a[:90], b[200:260] = 7.0, 0.3  # values with more rows than a strip
    df = frame(spark, ["k", "a", "b"], k=[0] * 250 + [1] * 150, a=a, b=b)
    more = df.unionByName(spark.createDataFrame([(1, 3.0, None), (1, None, 3.0)], df.schema))
    for keys, parts in ((["k"], [slice(0, 250), slice(250, n)]), ([], [slice(0, n)])):
        got = sorted(P.order_agreement(more, keys, "a", "b").collect(), key=lambda x: x[0])
        for row, at in zip(got, parts, strict=True):
            s = np.sign(a[at][:, None] - a[at]) * np.sign(b[at][:, None] - b[at])
            assert (row["n_concordant"], row["n_discordant"]) == ((s > 0).sum() // 2, (s < 0).sum() // 2)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_pairs_equal_all_distances(spark, k):
    ctx = np.repeat([0, 1], [40, 25])
    u = RNG.normal(size=65)
    df = frame(spark, ["ctx", "row", "u"], c=ctx, r=np.arange(65), u=u)
    none = spark.createDataFrame([], "ctx_a bigint, ctx_b bigint")
    for lim in (None, 0):
        got = {}
        for r in P.tier3(df, "ctx", "row", "u", none, k, lim).collect():
            got.setdefault(r["row_a"], set()).add(r["row_b"])
        for i in range(40):
            assert got[i] == set((40 + np.argsort(abs(u[i] - u[40:]), kind="stable")[:k]).tolist())


def test_nearest_vectors_across_blocks(spark):
    x = {c: RNG.normal(size=(n, 3)) for c, n in ((0, 21), (1, 34))}
    df = spark.createDataFrame([(c, c * 100 + i, v.tolist()) for c, m in x.items() for i, v in enumerate(m)], "c int, k int, v array<double>")
    got = {}
    for r in K.nearest(df, "c", "k", "v", k=3, size=8).collect():
        got.setdefault(r["row_a"], set()).add(r["row_b"])
    d = brute.sqdist(x[0], x[1])
    assert got == {i: set((100 + np.argsort(d[i])[:3]).tolist()) for i in range(21)}


def test_hot_cluster_is_cut_without_changing_the_result(spark, monkeypatch):
    n = 120
    df = frame(spark, ["c", "y", "p"], c=[0] * 80 + list(range(1, 41)), y=RNG.normal(size=n), p=RNG.normal(size=n))
    whole = sorted(B.cluster_bootstrap_rho(df, "c", "y", {"o": ["p"]}, 3, 1).collect())
    monkeypatch.setattr(B, "PART_ROWS", 10)
    cut = sorted(B.cluster_bootstrap_rho(df, "c", "y", {"o": ["p"]}, 3, 1).collect())
    assert [r["o"] for r in cut] == pytest.approx([r["o"] for r in whole])


@pytest.mark.parametrize("size,seed", [(1024, 0), (1024, 1), (7, 2), (7, 3)])
def test_mmd_equals_direct_kernel(spark, size, seed):
    """Few rows per context, so that a middle distance often lies within one context only."""
    rng = np.random.default_rng(seed)
    x = {c: rng.normal(c / 3, 1, (n, 5)) for c, n in ((0, 20), (1, 31), (2, 11), (3, 2), (4, 1))}
    rows = [(c, c * 100 + i, v.tolist()) for c, m in x.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "c int, k int, v array<double>")
    for r in K.mmd2_pairs(df, "c", "k", "v", size=size).collect():
        a, b = x[r["ctx_a"]], x[r["ctx_b"]]
        bw = brute.median_sq(np.vstack([a, b]))
        assert r["bandwidth_sq"] == pytest.approx(bw) and r["mmd2"] == pytest.approx(brute.mmd2(a, b, bw))


def test_soft_ranks_and_rbf_similarity_across_blocks(spark):
    n = 40
    v = RNG.normal(size=n)
    df = frame(spark, ["g", "k", "v"], g=[0] * n, k=np.arange(n), v=v)
    s = 1 / (1 + np.exp(-(v[:, None] - v[None, :]) / 0.1))
    np.fill_diagonal(s, 0)
    got = {r["k"]: r["soft_v"] for r in K.soft_ranks(df, "g", "k", ["v"], size=9).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(list(s.sum(1)))
    x, y = RNG.normal(size=(n, 3)), RNG.normal(size=(n, 4))
    d = spark.createDataFrame([(0, i, x[i].tolist(), y[i].tolist()) for i in range(n)], "g int, k int, x array<double>, y array<double>")
    kx, ky = (np.exp(-brute.sqdist(m, m) / (2 * brute.median_sq(m))) for m in (x, y))
    h = np.eye(n) - 1 / n
    hs = lambda p, q: ((h @ p @ h) * q).sum()
    want = hs(kx, ky) / np.sqrt(hs(kx, kx) * hs(ky, ky))
    assert K.rbf_cka(d, "g", "k", "x", "y", size=9).first()["rbf_cka"] == pytest.approx(want)


def test_linear_cka_and_penalty_equal_numpy(spark):
    x = RNG.normal(size=(50, 6))
    df = spark.createDataFrame([(0, r.tolist()) for r in x], "g int, v array<double>")
    g = L.gram(df, ["g"], F.col("v"))
    c = x - x.mean(0)
    a, b = c[:, :2], c[:, 2:]
    f = lambda m: np.linalg.norm(m)
    assert L.linear_cka(g, ["g"], 2, 6).first()["linear_cka"] == pytest.approx(f(b.T @ a) ** 2 / (f(a.T @ a) * f(b.T @ b)))
    s = 49.0
    assert L.covariance_penalty(g, ["g"], 2, 6).first()["penalty"] == pytest.approx((f(a.T @ b) / s) ** 2 / (f(a.T @ a) / s * f(b.T @ b) / s + 1e-8))


def test_ridge_equals_closed_form(spark):
    x = RNG.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + RNG.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(t), [float(q) for q in r]) for r, t in zip(x, y)], "a double, b double, c double, y double, v array<double>")
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.0, 1.0, 25.0):
        coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        pred = y.mean() + xc @ coef
        model = L.fit_linear(df, ["a", "b", "c"], "y", alpha)
        got = np.array([r["prediction"] for r in model.transform(df).select("prediction").collect()])
        assert np.abs(got - pred).max() < 1e-8
        g = L.gram(df, [], F.col("v"), ["y"])
        w = L.ridge_weights(g, [], 3, 1, [alpha], penalize_one=False)
        assert w.first()["w"][:3] == pytest.approx(list(coef))
        assert L.r2_from_gram(w, g, [], 3).first()["r2"] == pytest.approx(brute.r2(y, pred))
    assert L.fit_linear(df.withColumn("y", F.lit(1.0)), ["a"], "y") is None


def test_probe_and_separability_equal_numpy(spark):
    n, k = 60, 3
    z = RNG.normal(size=(n, 4)) + np.repeat(np.eye(4)[:k] * 2, n // k, axis=0)
    c = np.repeat(np.arange(k), n // k)
    df = spark.createDataFrame([(i, int(c[i]), z[i].tolist(), float(z[i, 0] ** 2)) for i in range(n)], "i int, c int, v array<double>, u double")
    zi = np.hstack([z, np.ones((n, 1))])
    u = z[:, 0] ** 2
    w = np.linalg.solve(zi.T @ zi + 1e-3 * np.eye(5), zi.T @ u)
    assert L.probe_r2(df, [], F.col("v"), ["u"]).first()["probe_r2"] == pytest.approx(brute.r2(u, zi @ w))
    fold = {r["i"]: r["fold"] for r in B.stratified_folds(df, "c", "i", 5, 0).collect()}
    f = np.array([fold[i] for i in range(n)])
    y = -np.ones((n, k))
    y[np.arange(n), c] = 1
    acc = []
    for q in range(5):
        t = f != q
        w = np.linalg.solve(zi[t].T @ zi[t] + np.eye(5), zi[t].T @ y[t])
        acc.append((np.argmax(zi[~t] @ w, 1) == c[~t]).mean())
    got = L.separability(df, "i", "v", "c").first()
    assert got["accuracy"] == pytest.approx(np.mean(acc)) and got["chance"] == pytest.approx(1 / 3)


def test_ndcg_shift_and_empty_gain(spark):
    y, p = np.array([-1.0, 0.0, 2.0, 3.0]), np.array([0.1, 0.9, 0.8, 0.2])
    df = frame(spark, ["g", "k", "y", "p"], g=[0] * 4, k=np.arange(4), y=y, p=p)
    top = (y + 1)[np.argsort(-p, kind="stable")][:2]
    best = np.sort(y + 1)[::-1][:2]
    dis = 1 / np.log2([2, 3])
    assert M.ndcg(df, ["g"], "y", "p", "k", 2).first()["ndcg"] == pytest.approx((top * dis).sum() / (best * dis).sum())
    assert M.ndcg(df.withColumn("y", F.lit(0.0)), ["g"], "y", "p", "k", 2).first()["ndcg"] is None


def test_gene_stats_count_absent_as_zero(spark):
    vals = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 4.0), ("a", 1, 1.0)], "g string, gene_idx int, mean double")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    got = {r["gene_idx"]: r for r in X.gene_stats(vals, groups).collect()}
    assert got[0]["var"] == pytest.approx(np.var([2, 4, 0])) and got[0]["lo"] == 0.0
    assert got[1]["mean"] == pytest.approx(1 / 3)


def test_top_genes_break_ties_by_index(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0), (0, 1.0)], "gene_idx int, var double")
    assert sorted(r["gene_idx"] for r in X.top_genes(df, "var", 3).collect()) == [0, 1, 2]


def test_registry_puts_control_last_unless_listed(spark):
    df = spark.createDataFrame([("b",), ("z",), ("a",)], "target string")
    assert [r["target"] for r in X.id_registry([df], "ctl").orderBy("target_id").collect()] == ["a", "b", "z", "ctl"]
    both = df.unionByName(spark.createDataFrame([("ctl",)], "target string"))
    assert [r["target"] for r in X.id_registry([both], "ctl").orderBy("target_id").collect()] == ["a", "b", "ctl", "z"]


def test_evenly_spaced_positions(spark):
    for n, m in ((101, 7), (10, 10), (5, 9)):
        got = [r["pos"] for r in X.evenly_spaced(spark.range(n).select("id"), "id", m).orderBy("pos").collect()]
        assert got == sorted(set(np.linspace(0, n - 1, m).astype(int).tolist()))


def test_alignment_refuses_missing_and_repeated_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    ok = spark.createDataFrame([(2, 5.0), (1, 4.0)], "k int, z double")
    assert sorted((r["k"], r["z"]) for r in J.align(a, ok, ["k"]).collect()) == [(1, 4.0), (2, 5.0)]
    for bad in ([(1, 4.0)], [(1, 4.0), (2, 5.0), (2, 6.0)], [(1, 1.0), (2, 1.0), (3, 1.0)]):
        with pytest.raises(Exception, match="do not align"):
            J.align(a, spark.createDataFrame(bad, "k int, z double"), ["k"]).collect()
    with pytest.raises(Exception, match="no value for key"):
        J.gather(a.select("k"), ok.where("k = 1"), "k").collect()


def test_audits_find_what_they_look_for(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, -1.0), (3, float("inf"))], "k int, v double")
    assert Q.unique_keys(df, ["k"]).first()["n_bad"] == 1
    assert Q.values_ok(df, "v").first()["n_bad"] == 3
    ids = spark.createDataFrame([("5", "int"), ("5", "text"), ("6", "int")], "id string, kind string")
    assert Q.cast_collisions(ids, "id", "kind").first()["n_bad"] == 1
    assert Q.covers_once(df.select("k"), spark.range(1, 5).select(F.col("id").cast("int").alias("k")), "k").first()["n_bad"] == 2
    assert Q.same_multiset(df, df.where("k < 3"), ["k"]).first()["n_bad"] == 1
    with pytest.raises(Q.Forbidden):
        Q.guard_columns(["a", "ad_stat_mean"], deny=["ad_stat_mean"])
    with pytest.raises(Q.Forbidden):
        Q.guard_splits(["train", "test"], ["train", "val"])
    assert Q.schema_matches(df, "k bigint, v double") == ["k: int is not bigint"]


def test_path_equality_grades(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    for eps, verdict in ((0.0, "EXACT"), (5e-9, "NUMERICALLY_EQUIVALENT"), (1e-3, "MISMATCH")):
        assert Q.path_equality(a, a.withColumn("v", F.col("v") + eps), ["k"], "v").first()["verdict"] == verdict


def test_selection_reads_validation_only(spark):
    s = spark.createDataFrame([("a", "f", 0, "test", 1.0, 1.0)], "arm string, family string, seed int, split string, y double, yhat double")
    with pytest.raises(Q.Forbidden):
        EV.validation_table(s)


def test_undefined_family_is_never_selected(spark):
    v = spark.createDataFrame([("a", "x", float("nan"), 0.1), ("a", "y", -3.0, 0.1), ("a", "z", None, 0.1)], "arm string, family string, mean double, sd double")
    r = M.selection_table(v, "arm", "family", "mean", "sd").first()
    assert r["selected"] == "y" and r["runner_up"] is None and r["margin"] is None


def test_variant_mismatch_and_guard(spark, tmp_path):
    df = spark.createDataFrame([("train", "1996", "A", 0, 1.0)], "split string, batch string, target string, gene_idx int, delta double")
    root = str(tmp_path)
    got = variants.reuse_variant(spark, root, "delta", "all", 1, lambda: df)
    assert dict(got.dtypes)["batch"] == "string" and got.count() == 1
    with pytest.raises(ValueError, match="stored variant"):
        variants.read_variant(spark, f"{root}/delta_all", "delta", "all", 2)
    with pytest.raises(variants.ForbiddenVariant):
        variants.variant_path(root, "raw", "hvg")
    with pytest.raises(variants.ForbiddenVariant):
        variants.variant_path(root, "delta", "hvg", gene_list="own", authoritative="shared")


def test_packed_columns_follow_numeric_suffix(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0, 1.0)], "k int, e_2 double, e_10 double, e_1 double")
    assert tables.pack_columns(df, r"e_\d+", "v", ["k"]).first()["v"] == [1.0, 2.0, 10.0]


def test_result_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("z", "R2", 0.15)], "arm string, metric string, value double")
    for fmt in ("csv", "json", "parquet"):
        tables.write_results(df, f"{tmp_path}/{fmt}", fmt)
        rd = spark.read.schema(df.schema).option("header", True).format(fmt).load(f"{tmp_path}/{fmt}")
        assert rd.collect() == df.collect()
    assert tables.as_document(df, ["arm"]).first()["doc"] == '{"metric":"R2","value":0.15}'


def test_ordered_digest(spark):
    """A tree of digests that knows types, borders and order, and no layout."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(i % 7 if i % 5 else None, ["a", "bc", None, ""][i % 4]) for i in range(50)] + [(1, "a"), (1, "a")]
    df = spark.createDataFrame(rows, "k int, s string")
    one = lambda k, s: sha("|".join(["int:-" if k is None else f"int:{len(str(k))}:{k}", "string:-" if s is None else f"string:{len(s)}:{s}"]))
    level = [h for _, _, h in sorted((k is not None, k or 0, one(k, s)) for k, s in rows)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    of = lambda d, **o: tuple(Q.ordered_digest(d, ["k"], ["k", "s"], 4, **o).first())
    assert of(df) == of(df.repartition(5), limit=0) == (52, level[0])
    other = [df.limit(51), df.withColumn("k", F.col("k").cast("bigint")), df.withColumn("s", F.upper("s")), df.union(df.limit(1))]
    assert len({of(d) for d in [df, *other]}) == 5
    assert of(df.where("false")) == (0, sha(""))
    with pytest.raises(ValueError, match="exact"):
        Q.ordered_digest(df.withColumn("s", F.lit(1.5)), ["k"], ["s"])


def test_draw_masks_hold_fixed_sizes(spark):
    from screenloom.operators.endpoint import WORD, draw_masks

    cells = spark.createDataFrame([(i, "big" if i < 40 else "small") for i in range(46)], "cell_id long, batch string")
    draws = WORD + 5
    rows = draw_masks(cells, ["batch"], 9, draws, 3).collect()
    assert {r.batch for r in rows} == {"big"}  # fewer than nine cells: left out
    held = [{r.cell_id for r in rows if r[f"w{d // WORD}"] >> (d % WORD) & 1} for d in range(draws)]
    assert all(len(h) == 9 for h in held)
    assert len({frozenset(h) for h in held}) == draws
    assert not any(r.w1 >> 5 for r in rows) and all(r.w0 >= 0 for r in rows)


def test_only_small_keys_are_put_in_order(spark, monkeypatch):
    from screenloom.functions.hashing import order_key

    cells = spark.range(6000).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 5950, "big").otherwise("small").alias("batch"))
    o = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("draw")).withColumn("o", order_key(5, F.col("draw"), F.col("cell_id"))).collect()
    want = {b: [{r.cell_id for r in sorted((r for r in o if r.draw == d and r.batch == b), key=lambda r: r.o)[:30]} for d in (1, 2, 3)] for b in ("big", "small")}
    for few, root in ((True, math.sqrt(30)), (False, -7.0)):  # below the second bound are too few keys: the group comes whole
        monkeypatch.setattr(E.math, "sqrt", lambda n: root)
        assert (E._smallest_keys(cells, ["batch"], 30, 3, 5).count() < 1000) == few
        rows = E.draw_masks(cells, ["batch"], 30, 3, 5).collect()
        assert {b: [{r.cell_id for r in rows if r.batch == b and r.w0 >> d & 1} for d in range(3)] for b in want} == want


def test_draws_in_pieces_are_the_plain_hash(monkeypatch):
    monkeypatch.setattr(draws, "IN_CACHE", 7)
    for n in (1, 2, 50, 64, 1 << 18):
        own = draws.key(42, 3, 1)
        plain = draws.fmix(((np.arange(1, 101, dtype=np.uint64) * np.uint64(draws.PHI)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        want = draws.fmix(plain ^ own).astype(np.uint64) * np.uint64(n) >> np.uint64(32)
        assert np.array_equal(draws.hits(own, draws.numbers(0, 100), n), want.astype(np.int64))


def test_moments_of_many_replicates_are_summed_together(monkeypatch):
    monkeypatch.setattr(B, "ROWS_AT_ONCE", 9)
    moments = np.r_[np.ones((1, 40)), RNG.normal(size=(3, 40)), np.ones((1, 40))]
    weights = RNG.integers(0, 5, (6, 40)).astype(np.int32)
    assert np.allclose(B._weighted(moments, weights), weights @ moments.T, rtol=1e-12)


def test_family_without_draws_is_fitted_once_for_all_seeds(spark):
    rows = spark.createDataFrame([(i, ["train", "val", "test"][i % 3], float(i % 7), [float(i % 5), float(i * i % 11)]) for i in range(60)], "k long, split string, y double, z array<double>")
    fitted = []

    def ridge(train, features, label, seed):
        fitted.append(seed)
        return L.fit_linear(train, features, label, alpha=1.0)

    out = lambda **more: sorted(tuple(r) for r in EV.sweep(rows, {"z": ["z"]}, {"ridge": ridge}, [0, 1, 2], "k", "y", **more).collect())
    once = out(seedless=("ridge",))
    assert fitted == [0] and len(once) == 3 * 40
    assert [r[:6] for r in once] == [r[:6] for r in out()] and fitted == [0, 0, 1, 2]


def test_vector_of_normals_is_made_of_single_ones(spark):
    """Seed and key are joined once a row; the numbers are those of ``normal``."""
    from screenloom.functions import hashing as H

    rows = spark.range(4).select("id", F.array(*[(F.col("id") * j % 7).cast("double") for j in range(6)]).alias("x"))
    out = rows.select(H.normals(F.col("id") + 5, F.col("id"), 5).alias("n"), F.array(*[H.normal(F.col("id") + 5, "id", F.lit(i)) for i in range(1, 6)]).alias("m"), "x", *V.magnitude("x"))
    for r in out.collect():
        assert r["n"] == r["m"]
        assert r["sd"] == pytest.approx((sum((v - sum(r["x"]) / 6) ** 2 for v in r["x"]) / 6) ** 0.5)
