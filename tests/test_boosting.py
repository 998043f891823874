"""Boosted trees against trees grown row by row."""
import numpy as np
from pyspark.sql import functions as F

from screenloom.operators import boosting as G
from screenloom.plans import evaluation as EV

KIND = "g int, v array<double>, y double, held boolean"


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 1] > 0.3, 2.0, -1.0) + x[:, 0] ** 2 + rng.normal(size=n) * 0.1
    return x, y, np.arange(n) % 10 == 7


def cut_points(x, bins):
    out = []
    for j in range(x.shape[1]):
        v = np.sort(x[:, j])
        out.append(np.unique([v[int(np.ceil(i / bins * len(v))) - 1] for i in range(1, bins)]))
    return out


def plain_tree(x, g, edges, depth, leaf, leaves):
    """Grown by the largest gain, every cut tried on the rows themselves: a list of [rows, depth, value]."""
    def best(at):
        s, n, out = g[at].sum(), len(at), None
        for j, cuts in enumerate(edges):
            for e in cuts:
                left = at[x[at, j] <= e]
                if leaf <= len(left) <= n - leaf:
                    sl = g[left].sum()
                    gain = sl * sl / len(left) + (s - sl) ** 2 / (n - len(left)) - s * s / n
                    if gain > 1e-10 and (out is None or gain > out[0] + 1e-9):
                        out = gain, j, e
        return out

    open_ = [(np.arange(len(x)), 0, 0)]
    done, made = [], 1
    while open_ and made < leaves:
        cuts = [best(at) if d < depth else None for at, d, _ in open_]
        gains = [-1.0 if c is None else c[0] for c in cuts]
        i = int(np.argmax(gains))
        if gains[i] < 0:
            break
        (at, d, node), (_, j, e) = open_.pop(i), cuts[i]
        made += 1
        open_ += [(at[x[at, j] <= e], d + 1, 2 * node + 1), (at[x[at, j] > e], d + 1, 2 * node + 2)]
    return done + open_


def test_against_rows(spark):
    x, y, held = rows(240)
    df = spark.createDataFrame([(0, a.tolist(), float(b), bool(h)) for a, b, h in zip(x, y, held)], KIND)
    m = G.fit(df, [], "v", "y", "held", rounds=3, depth=3, step=0.5, bins=8, leaf=5, leaves=6)
    t, u = x[~held], y[~held]
    edges = cut_points(t, 8)
    f = np.full(len(t), u.mean())
    for tree in m.trees[0]:
        grown = plain_tree(t, u - f, edges, 3, 5, 6)
        assert sorted(n for _, _, n in grown) == sorted(set(tree.nodes(G._binned_array(t, edges)).tolist()))
        for at, _, node in grown:
            assert tree.rows[node] == len(at)
            f[at] += 0.5 * (u - f)[at].mean()
    got = {tuple(r.v): r.prediction for r in m.transform(df.where("NOT held")).collect()}
    assert max(abs(got[tuple(a)] - b) for a, b in zip(t.tolist(), f)) < 1e-9


def test_models_do_not_mix_and_stop(spark):
    """Together or alone a model is the same; noise stops early; predictions survive being written (every tenth tree)."""
    x, y, held = rows(200, 1)
    rng = np.random.default_rng(2)
    data = [(0, a.tolist(), float(b), bool(h)) for a, b, h in zip(x, y, held)] + [(1, a.tolist(), float(rng.normal()), bool(h)) for a, h in zip(x, held)]
    df = spark.createDataFrame(data, KIND)
    size = dict(rounds=12, depth=2, step=0.3, bins=16, leaf=5, patience=3)
    both = G.fit(df, ["g"], "v", "y", "held", **size)
    alone = G.fit(df.where("g = 0"), ["g"], "v", "y", "held", **size)
    assert len(both.trees[0]) == len(alone.trees[0]) == 12 and len(both.trees[1]) < 12
    one = [r.prediction for r in both.transform(df.where("g = 0")).orderBy("v", "y").collect()]
    two = [r.prediction for r in alone.transform(df.where("g = 0")).orderBy("v", "y").collect()]
    assert np.abs(np.array(one) - np.array(two)).max() < 1e-9
    assert both.losses[0][-1] < both.losses[0][0] / 3


def test_odd_rows(spark):
    data = [(0, [float(i), None], float(i % 2), False) for i in range(40)] + [(0, None, 1.0, False), (0, [1.0, 2.0], None, False), (0, [float("nan"), 0.0], 1.0, None)]
    data += [(1, [1.0, 1.0], 3.0, False)] * 30 + [(2, [1.0, 1.0], 3.0, True)]
    df = spark.createDataFrame(data, KIND)
    m = G.fit(df, ["g"], "v", "y", "held", rounds=2, depth=2, leaf=5)
    out = m.transform(df)
    assert out.columns == [*df.columns, "prediction"] and out.count() == len(data)
    assert [r.prediction for r in out.where("g = 1").distinct().collect()] == [3.0]  # constant label
    assert out.where("g = 2 AND prediction IS NOT NULL").isEmpty()  # nothing to train on
    assert out.where("g = 0 AND v IS NULL AND prediction IS NOT NULL").isEmpty()
    assert m.table(spark).where("g = 1").isEmpty()
    empty = G.fit(df.where("false"), ["g"], "v", "y", "held", rounds=2)
    assert empty.transform(df).where(F.col("prediction").isNotNull()).isEmpty() and empty.table(spark).isEmpty()


def test_sweep_draws_held_rows_by_seed(spark):
    x, y, _ = rows(120, 3)
    df = spark.createDataFrame([(i, ["train", "val", "test"][max(0, i % 5 - 2)], a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, split string, v array<double>, y double")
    out = EV.sweep_boosted(df, {"v": ["v"], "vy": ["v", "k"]}, [0, 1], "k", "y", rounds=2, depth=2, leaf=5)
    assert out.groupBy("arm", "seed", "split").count().where("count <> 24").isEmpty()
    assert out.groupBy("arm", "key").agg(F.count_distinct("yhat").alias("n")).where("n = 2").count() > 0


def test_edges_are_exact_for_many_rows(spark):
    """Quantiles of 240,000 values, a part of them tied, are the values at their places."""
    n, bins = 240_000, 32
    df = spark.range(n).selectExpr("array(pmod(id * 7919, 240000) + 0.25, id % 7) AS v")
    got = {e.pos: e.edges for e in G.bin_edges(df, [], "v", bins).collect()}
    for pos, x in ((0, np.arange(n) + 0.25), (1, np.sort(np.arange(n) % 7).astype(float))):
        assert got[pos] == sorted({x[-(-q * n // bins) - 1] for q in range(1, bins)})
