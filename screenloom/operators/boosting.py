"""Boosted regression trees on binned features, many models at once.

Features are cut at quantiles of the training rows once; a row then is one byte for each feature.  For each level of a tree
there is one aggregate, (model, node, feature, bin) -> sum of residuals and rows: a task adds up its own rows in Arrow, so
the shuffle carries histograms, never rows.  Only the smaller child of a split is added up; its sibling is the parent's
histogram less that.  The driver sees the best split of each node and nothing else, and all models (arms, seeds) share the
jobs of a level.  Residuals come from the trees since the rows' predictions were last written, every ``KEEP`` trees.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from screenloom.functions.ordered import running
from screenloom.session import durable

#: Trees after which the rows' predictions are written anew.
KEEP = 10
#: Least gain of a split, and least improvement on held rows that counts.
LEAST_GAIN, TOLERANCE = 1e-10, 1e-7


class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2; ``feature`` is -1 where a node does not split."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.cut = np.full(size, -1), np.zeros(size, dtype=np.int64)
        self.gain, self.total, self.rows = np.zeros(size), np.zeros(size), np.zeros(size, dtype=np.int64)

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """Node of each row of bins."""
        at, every = np.zeros(len(binned), dtype=np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            f = self.feature[at]
            right = binned[every, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def split(self, node: int, feature: int, cut: int, gain: float, left: tuple, total: tuple) -> None:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        for child, (s, n) in ((2 * node + 1, left), (2 * node + 2, (total[0] - left[0], total[1] - left[1]))):
            self.total[child], self.rows[child] = s, n

    def grow_best_first(self, leaves: int) -> None:
        """Keep the splits that growing by the largest gain makes until there are ``leaves`` leaves."""
        kept, open_ = set(), [0] if self.feature[0] >= 0 else []
        while open_ and len(kept) + 1 < leaves:
            node = min(open_, key=lambda i: (-self.gain[i], i))
            open_.remove(node)
            kept.add(node)
            open_ += [c for c in (2 * node + 1, 2 * node + 2) if self.feature[c] >= 0]
        drop = np.ones(len(self.feature), dtype=bool)
        drop[list(kept)] = False
        self.feature[drop] = -1

    def values(self, step: float) -> np.ndarray:
        return step * np.divide(self.total, self.rows, out=np.zeros(len(self.total)), where=self.rows > 0)


def bin_edges(df: DataFrame, by: list[str], vec: str, bins: int) -> DataFrame:
    """by, pos, edges: distinct exact quantiles of each feature, for any number of rows; a value's bin is the number of edges
    below it."""
    long = df.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ties = running(long.groupBy(*by, "pos", "x").agg(F.count("x").alias("c")), [*by, "pos"], ["x"], ["c"])
    # the q-th quantile of n values is the one at place ceil(q n / bins), so a value is an edge if some q is reached with it
    reached = ties.withColumns({"lo": F.expr(f"c_before * {bins} div c_total"), "hi": F.expr(f"(c_before + c) * {bins} div c_total")})
    return reached.where(F.least("hi", F.lit(bins - 1)) > F.col("lo")).groupBy(*by, "pos").agg(F.array_sort(F.collect_list("x")).alias("edges"))


def _binned_array(x: np.ndarray, edges: list) -> np.ndarray:
    """Bins of rows of features; NaN lies above every edge."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def _binned(values, edges: list) -> np.ndarray:
    """Bins of an Arrow list column whose lists are as long as ``edges``."""
    return _binned_array(np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(values), len(edges)), edges)


def _bytes(column, n: int) -> np.ndarray:
    width = len(column[0].as_py()) if n else 0
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(n, width)


def _bins_of(edges: dict):
    """Arrow task: ``vec`` of each row as one byte for each feature, by the row's model."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            model = batch["model"].to_numpy()
            out = np.empty(len(model), dtype=object)
            for m in np.unique(model):
                at = np.flatnonzero(model == m)
                b = _binned(batch["vec"].take(pa.array(at)), edges[m])
                for i, row in zip(at, b):
                    out[i] = row.tobytes()
            cols = [c for c in batch.schema.names if c != "vec"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in cols], pa.array(out, pa.binary())], names=[*cols, "bins"])

    return run


def _added(margin: np.ndarray, binned: np.ndarray, trees: list[Tree], step: float) -> np.ndarray:
    for t in trees:
        margin = margin + t.values(step)[t.nodes(binned)]
    return margin


def _predicted(trees: dict, step: float, keep: list[str]):
    """Arrow task: ``f`` moved on by the given trees of each model."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            model, f = batch["model"].to_numpy(), batch["f"].to_numpy().copy()
            for m in np.unique(model):
                at = np.flatnonzero(model == m)
                f[at] = _added(f[at], _bytes(batch["bins"].take(pa.array(at)), len(at)), trees.get(m, []), step)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(f)], names=[*keep, "f"])

    return run


def _histograms(trees: dict, tree: dict, build: dict, bins: int, step: float, losses: bool):
    """Arrow task: sums and counts of (model, node, feature, bin) over training rows in the nodes to build; with ``losses``
    also the squared error on held rows, as node -1."""

    def run(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            model, y, f = batch["model"].to_numpy(), batch["y"].to_numpy(), batch["f"].to_numpy()
            outside = batch["held"].to_numpy(zero_copy_only=False).astype(bool)
            for m in np.unique(model):
                if m not in build:
                    continue
                at = np.flatnonzero(model == m)
                b = _bytes(batch["bins"].take(pa.array(at)), len(at))
                rest = y[at] - _added(f[at], b, trees.get(m, []), step)
                out = outside[at]
                if losses and out.any():
                    s, n = held.setdefault((m, -1), (np.zeros(1), np.zeros(1, np.int64)))
                    s += (rest[out] ** 2).sum()
                    n += out.sum()
                node = np.where(out, -1, tree[m].nodes(b))
                for k in build[m]:
                    mine = node == k
                    if not mine.any():
                        continue
                    place = (b[mine].astype(np.int64) + np.arange(b.shape[1]) * bins).ravel()
                    size = b.shape[1] * bins
                    s, n = held.setdefault((m, k), (np.zeros(size), np.zeros(size, np.int64)))
                    s += np.bincount(place, weights=np.repeat(rest[mine], b.shape[1]), minlength=size)
                    n += np.bincount(place, minlength=size)
        for (m, k), (s, n) in held.items():
            at = np.flatnonzero(n)
            whole = lambda x: pa.array(np.full(len(at), x, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [whole(m), whole(k), pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)), pa.array(s[at]), pa.array(n[at])],
                names=["model", "node", "feature", "bin", "s", "n"],
            )

    return run


def scanned(parts: DataFrame) -> DataFrame:
    """Histograms from their parts: the sum and rows of every bin, of the bins up to it (sl, nl) and of its node.  One shuffle:
    the sums and the scan along the bins share a partitioning."""
    hist = parts.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg({"s": "sum", "n": "sum"})
    line = "(PARTITION BY model, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    whole = "(PARTITION BY model, node, feature)"
    return hist.selectExpr("model", "node", "feature", "bin", "`sum(s)` AS s", "`sum(n)` AS n").where("n > 0").selectExpr(
        "*", f"sum(s) OVER {line} AS sl", f"sum(n) OVER {line} AS nl", f"sum(s) OVER {whole} AS total", f"sum(n) OVER {whole} AS rows")


def best_splits(hist: DataFrame, leaf: int) -> DataFrame:
    """model, node, s, n and ``best`` (gain, feature, bin, left sum, left rows; null without a split) of each node: the cut
    with the largest reduction of the squared error that leaves ``leaf`` rows on both sides; ties go to the smaller feature,
    then the smaller bin."""
    gain = hist.selectExpr("*", "try_divide(sl * sl, nl) + try_divide((total - sl) * (total - sl), rows - nl) - total * total / rows AS gain")
    cut = f"CASE WHEN nl >= {leaf} AND rows - nl >= {leaf} AND gain > {LEAST_GAIN} THEN struct(gain, -feature AS feature, -bin AS bin, sl, nl) END"
    best = gain.selectExpr("model", "node", "feature", "struct(total AS s, rows AS n) AS own", f"{cut} AS cut").groupBy("model", "node")
    return best.agg(F.expr("min_by(own, feature) AS own"), F.expr("max(cut) AS best")).selectExpr("model", "node", "own.s", "own.n", "best")


class Boosted:
    """Fitted models: ``keys`` (by-values to number), ``edges``, ``base`` and ``trees`` of each, and the held-out losses."""

    def __init__(self, by, vec, keys, edges, base, trees, step, losses):
        self.by, self.vec, self.keys, self.edges, self.base = by, vec, keys, edges, base
        self.trees, self.step, self.losses = trees, step, losses

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with predictions, null for rows of models that were not fitted and for null vectors."""
        kept = [c for c in df.columns if c != prediction]
        inner = F.struct(*kept).alias("row")
        rows = _numbered(df.select(*kept), self.by, self.keys).select(inner, "model", F.col(self.vec).cast("array<double>").alias("vec"))
        edges, base, trees, step = self.edges, self.base, self.trees, self.step

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                model = np.asarray(batch["model"].fill_null(-1).to_numpy(zero_copy_only=False))
                out = np.full(len(model), np.nan)
                present = np.asarray(batch["vec"].is_valid().to_numpy(zero_copy_only=False))
                for m in np.unique(model[model >= 0]):
                    at = np.flatnonzero((model == m) & present)
                    if len(at):
                        b = _binned(batch["vec"].take(pa.array(at)), edges[m])
                        out[at] = _added(np.full(len(at), base[m]), b, trees[m], step)
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, mask=np.isnan(out))], names=["row", "p"])

        kind = df.select(*kept).schema.simpleString()
        return rows.mapInArrow(run, f"row {kind}, p double").select("row.*", F.col("p").alias(prediction))

    def table(self, spark) -> DataFrame:
        """The by-values, tree, node, feature, threshold, gain, n, value of every node that is reached."""
        rows = []
        for key, m in self.keys.items():
            for t, tree in enumerate(self.trees[m]):
                value = tree.values(self.step)
                for node in range(len(tree.feature)):
                    if node and (tree.feature[(node - 1) // 2] < 0):
                        continue
                    f = int(tree.feature[node])
                    rows.append((*key, t, node, f if f >= 0 else None, float(self.edges[m][f][tree.cut[node]]) if f >= 0 else None,
                                 float(tree.gain[node]) if f >= 0 else None, int(tree.rows[node]), float(value[node])))
        kinds = ", ".join(f"`{b}` {k}" for b, k in self.by_types)
        return spark.createDataFrame(rows, (kinds + ", " if kinds else "") + "tree int, node int, feature int, threshold double, gain double, n bigint, value double")


def _numbered(df: DataFrame, by: list[str], keys: dict) -> DataFrame:
    """``df`` with the number of its model: null where there is none."""
    if not by:
        return df.withColumn("model", F.lit(0 if keys else None).cast("int"))
    hit = F.lit(None).cast("int")
    for key, m in keys.items():  # few: one for each model that is fitted
        same = F.lit(True)
        for b, k in zip(by, key):
            same = same & F.col(b).eqNullSafe(F.lit(k))
        hit = F.when(same, F.lit(m)).otherwise(hit)
    return df.withColumn("model", hit)


def fit(
    df: DataFrame, by: list[str], vec: str, label: str, held: str, rounds: int = 500, depth: int = 6, step: float = 0.05,
    bins: int = 255, leaf: int = 20, leaves: int = 31, patience: int = 20,
) -> Boosted:
    """One boosted model for each group in ``by`` (few), all fitted together; rows with ``held`` true only decide when to stop.

    A model stops when none of its last ``patience`` trees lowered the held rows' mean squared error below that of the tree
    before them, and keeps its trees; without held rows it makes all ``rounds``.  A tree has ``depth`` levels at most and
    ``leaves`` leaves, grown by the largest gain.  Vectors of a group have one width.  Rows with a null or NaN label or a
    null vector take no part; null and NaN components lie above every cut.  A group without training rows gets no model;
    one whose label is constant or that no cut divides predicts the mean."""
    if not 2 <= bins <= 256:
        raise ValueError("a bin is one byte")
    y = F.col(label).cast("double")
    rows = durable(df.select(*by, F.col(vec).cast("array<double>").alias("vec"), y.alias("y"), F.coalesce(F.col(held), F.lit(False)).alias("held")).where(
        F.col(vec).isNotNull() & y.isNotNull() & ~F.isnan(y)))
    train = rows.where(~F.col("held"))
    groups = (train.groupBy(*by) if by else train.groupBy()).agg(F.sum("y").alias("s"), F.count("y").alias("n"), F.max(F.size("vec")).alias("w")).collect()
    groups = [g for g in groups if g.n]
    keys = {tuple(g[b] for b in by): i for i, g in enumerate(sorted(groups, key=lambda g: tuple(str(g[b]) for b in by)))}
    base = {keys[tuple(g[b] for b in by)]: g.s / g.n for g in groups}
    width = {keys[tuple(g[b] for b in by)]: g.w for g in groups}
    edges = {m: [np.zeros(0)] * w for m, w in width.items()}
    for e in bin_edges(train, by, "vec", bins).collect():  # at most bins - 1 numbers for each model and feature
        edges[keys[tuple(e[b] for b in by)]][e.pos] = np.array(e.edges)
    trees: dict = {m: [] for m in base}
    losses: dict = {m: [] for m in base}
    model = Boosted(by, vec, keys, edges, base, trees, step, losses)
    model.by_types = [(b, df.schema[b].dataType.simpleString()) for b in by]
    if not keys:
        return model
    spark = df.sparkSession
    numbered = _numbered(rows, by, keys).where(F.col("model").isNotNull()).select("model", "y", "held", "vec")
    start = F.element_at(F.create_map(*[F.lit(x) for m, b in base.items() for x in (m, b)]), F.col("model"))
    binned = durable(numbered.mapInArrow(_bins_of(edges), "model int, y double, held boolean, bins binary").withColumn("f", start))
    stored = 0
    active = set(base)
    parts = "model int, node int, feature int, bin int, s double, n bigint"
    for r in range(rounds):
        if r - stored == KEEP:
            binned = durable(binned.mapInArrow(_predicted({m: t[stored:] for m, t in trees.items()}, step, ["model", "y", "held", "bins"]), "model int, y double, held boolean, bins binary, f double"))
            stored = r
        since = {m: trees[m][stored:] for m in active}
        tree = {m: Tree(depth) for m in active}
        build, pairs, hist = {m: [0] for m in active}, [], None
        for level in range(depth):
            made = binned.mapInArrow(_histograms(since, tree, build, bins, step, not level), parts)
            if level:
                pair = F.broadcast(_small(spark, pairs, ["model", "parent", "node", "other"]))
                sign = F.array(F.struct(F.col("node").alias("node"), F.lit(1).alias("w")), F.struct(F.col("other").alias("node"), F.lit(-1).alias("w")))
                both = made.join(pair, ["model", "node"]).select("model", "feature", "bin", "s", "n", F.inline(sign).alias("node", "w"))
                both = both.select("model", "node", "feature", "bin", (F.col("s") * F.col("w")).alias("s"), (F.col("n") * F.col("w")).alias("n"))
                whole = hist.withColumnRenamed("node", "parent").join(pair.drop("node"), ["model", "parent"])
                made = both.unionByName(whole.select("model", F.col("other").alias("node"), "feature", "bin", "s", "n"))
            hist = scanned(made)
            if level < depth - 1:
                hist = durable(hist)
            found = best_splits(hist, leaf).collect()  # a row for each node of the level
            if not level:
                for x in found:
                    if x.node < 0:
                        losses[x.model].append(x.s / x.n)
                for m in [m for m in active if _stalled(losses[m], patience)]:
                    active.discard(m)
            build, pairs = {}, []
            for x in found:
                if x.node < 0 or x.model not in active:
                    continue
                t = tree[x.model]
                if not x.node:
                    t.total[0], t.rows[0] = x.s, x.n
                if x.best is None:
                    continue
                t.split(x.node, -x.best.feature, -x.best.bin, x.best.gain, (x.best.sl, x.best.nl), (x.s, x.n))
                small, other = sorted((2 * x.node + 1, 2 * x.node + 2), key=lambda i: (t.rows[i], i))
                build.setdefault(x.model, []).append(small)
                pairs.append((x.model, x.node, small, other))
            if not pairs:
                break
        for m in sorted(active):
            tree[m].grow_best_first(leaves)
            if tree[m].feature[0] < 0:
                active.discard(m)
                continue
            trees[m].append(tree[m])
        if not active:
            break
    return model


def _small(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of integers as a local table, which needs no job."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({c: pa.array([int(x[i]) for x in rows], pa.int32()) for i, c in enumerate(names)}))


def _stalled(losses: list[float], patience: int) -> bool:
    return len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - TOLERANCE
