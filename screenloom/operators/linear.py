"""Linear fits and second-moment statistics from cross-product tables.

One pass over the rows gives, per group, all sums of products of the stacked columns
[vector, 1, targets].  Ridge fits for any number of targets and penalties, their R2, covariances and
linear similarity follow from that table, whose size is the square of the width, not of the rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.session import durable

ALPHAS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
HELD = 64


def gram(df: DataFrame, by: list[str], vec, targets: list[str] = []) -> DataFrame:
    """by, i, j, s: sums of products; positions are the vector's, then 1, then the targets.

    Each task multiplies its Arrow batches and keeps one matrix per group (at most HELD of them, then
    it hands them on), so the shuffle carries matrices, never rows."""
    stacked = df.select(
        *by, F.concat(vec.cast("array<double>"), F.array(F.lit(1.0), *[F.col(t).cast("double") for t in targets])).alias("v")
    )
    fields = [stacked.schema[b] for b in by]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "i int, row array<double>"])

    def part(batches):
        held: dict = {}

        def out():
            rows = [(*k, i, m[i].tolist()) for k, m in held.items() for i in range(len(m))]
            held.clear()
            return pd.DataFrame(rows, columns=[*by, "i", "row"])

        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for k, g in groups:
                k = k if isinstance(k, tuple) else (k,)
                m = np.stack(g["v"].to_numpy())
                held[k] = held[k] + m.T @ m if k in held else m.T @ m
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    rows = stacked.mapInPandas(part, schema)
    return rows.select(*by, "i", F.posexplode("row").alias("j", "s")).groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def covariances(g: DataFrame, by: list[str], one: int) -> DataFrame:
    """by, i, j, c (sum of centred products), n from a cross-product table; ``one`` is the place of
    the constant."""
    mean = g.where(F.col("j") == one)
    mi = mean.select(*by, "i", F.col("s").alias("si"))
    mj = mean.select(*by, F.col("i").alias("j"), F.col("s").alias("sj"))
    n = mean.where(F.col("i") == one).select(*by, F.col("s").alias("n"))
    j = g.where((F.col("i") != one) & (F.col("j") != one)).join(mi, [*by, "i"]).join(mj, [*by, "j"])
    j = j.join(n, by) if by else j.withColumn("n", n.scalar())
    return j.select(*by, "i", "j", (F.col("s") - F.col("si") * F.col("sj") / F.col("n")).alias("c"), "n")


def _blocks(cov: DataFrame, by: list[str], cut: int, scale) -> DataFrame:
    c = F.col("c") / scale if scale is not None else F.col("c")
    left, right = F.col("i") < cut, F.col("j") < cut
    g = cov.groupBy(*by) if by else cov.groupBy()
    return g.agg(
        F.sum(F.when(left & ~right, c * c)).alias("xy"), F.sum(F.when(left & right, c * c)).alias("xx"),
        F.sum(F.when(~left & ~right, c * c)).alias("yy"),
    )


def covariance_penalty(g: DataFrame, by: list[str], cut: int, one: int, eps: float = 1e-8) -> DataFrame:
    """Squared cross-covariance norm over the product of the two own norms."""
    b = _blocks(covariances(g, by, one), by, cut, F.greatest(F.col("n") - 1, F.lit(1.0)))
    return b.select(*by, (F.col("xy") / (F.sqrt("xx") * F.sqrt("yy") + eps)).alias("penalty"))


def linear_cka(g: DataFrame, by: list[str], cut: int, one: int) -> DataFrame:
    b = _blocks(covariances(g, by, one), by, cut, None)
    return b.select(*by, F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("linear_cka"))


def ridge_weights(g: DataFrame, by: list[str], width: int, n_targets: int, alphas: list[float], penalize_one: bool, target: str = "target") -> DataFrame:
    """by, target, alpha, w: coefficients with the intercept last.  One small solve per group, in the
    task that holds the group's (width + 1 + targets)^2 products."""
    fields = [g.schema[b] for b in by]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"{target} int, alpha double, w array<double>"])
    size = width + 1 + n_targets

    def solve(key, pdf):
        m = np.zeros((size, size))
        m[pdf["i"], pdf["j"]] = pdf["s"]
        a, rhs = m[: width + 1, : width + 1], m[: width + 1, width + 1:]
        rows = []
        for al in alphas:
            if penalize_one:
                w = np.linalg.solve(a + al * np.eye(width + 1), rhs)
            else:
                n = m[width, width]
                mx = m[:width, width] / n
                my = m[width, width + 1:] / n
                sxx = m[:width, :width] - n * np.outer(mx, mx)
                sxy = m[:width, width + 1:] - n * np.outer(mx, my)
                coef = np.linalg.lstsq(sxx + al * np.eye(width), sxy, rcond=None)[0] if al == 0 else np.linalg.solve(sxx + al * np.eye(width), sxy)
                w = np.vstack([coef, my - mx @ coef])
            rows += [(*key, t, float(al), w[:, t].tolist()) for t in range(n_targets)]
        return pd.DataFrame(rows, columns=[*by, target, "alpha", "w"])

    if by:
        return g.groupBy(*by).applyInPandas(solve, schema)
    return g.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: solve((), pdf), schema)


def r2_from_gram(weights: DataFrame, g: DataFrame, by: list[str], width: int, target: str = "target") -> DataFrame:
    """R2 of each fit on the rows behind ``g``, from their products alone: no scoring pass.

    The squared error is yy - 2 w'Xy + w'XXw, with each product one row of ``g``."""
    fit = [*by, target, "alpha"]
    w = weights.select(*fit, F.posexplode("w").alias("j", "_w"))
    inside = (F.col("i") <= width) & (F.col("j") <= width)
    image = g.where(inside).join(w, [*by, "j"]).groupBy(*fit, "i").agg(F.sum(F.col("s") * F.col("_w")).alias("_aw"))
    wi = w.withColumnRenamed("j", "i")
    quad = image.join(wi, [*fit, "i"]).groupBy(*fit).agg(F.sum(F.col("_aw") * F.col("_w")).alias("_waw"))
    xy = g.where((F.col("i") <= width) & (F.col("j") > width)).withColumn(target, F.col("j") - (width + 1)).drop("j")
    lin = xy.join(wi, [*by, target, "i"]).groupBy(*fit).agg(F.sum(F.col("s") * F.col("_w")).alias("_wxy"))
    own = g.where((F.col("i") == F.col("j")) & (F.col("i") > width)).select(*by, (F.col("i") - (width + 1)).alias(target), F.col("s").alias("_yy"))
    sums = g.where((F.col("i") == width) & (F.col("j") > width)).select(*by, (F.col("j") - (width + 1)).alias(target), F.col("s").alias("_y"))
    rows = g.where((F.col("i") == width) & (F.col("j") == width)).select(*by, F.col("s").alias("_n"))
    j = quad.join(lin, fit).join(own, [*by, target]).join(sums, [*by, target])
    j = j.join(rows, by) if by else j.withColumn("_n", rows.scalar())
    sst = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_n")
    sse = F.col("_yy") - 2 * F.col("_wxy") + F.col("_waw")
    return j.select(*fit, F.when(sst > 0, 1 - F.try_divide(sse, sst)).alias("r2"))


def assembled(df: DataFrame, features: list[str], name: str = "_x") -> DataFrame:
    """``features`` (numbers or arrays, in order) as one vector column."""
    kinds = dict(df.dtypes)
    parts = [F.col(f).cast("array<double>") if kinds[f].startswith("array") else F.array(F.col(f).cast("double")) for f in features]
    return df.withColumn(name, array_to_vector(F.concat(*parts)))


class Fitted:
    """A fitted model with the features it reads."""

    def __init__(self, model, features: list[str]):
        self.model, self.features = model, features

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assembled(df, self.features)).drop("_x")


def fit_linear(df: DataFrame, features: list[str], label: str, alpha: float = 0.0, prediction: str = "prediction"):
    """Ordinary (alpha 0) or ridge regression with a free intercept, as a Spark ML model; features are
    numbers or arrays.

    Spark scales its penalty by the label's spread, so the usual alpha becomes
    alpha * stddev_pop(y) / n.  Returns None when the label is constant or there are no rows."""
    n, sd = df.agg(F.count(label), F.stddev_pop(label)).first()
    if not n or not sd:
        return None
    lr = LinearRegression(
        featuresCol="_x", labelCol=label, predictionCol=prediction, solver="normal", standardization=False,
        elasticNetParam=0.0, regParam=alpha * sd / n,
    )
    return Fitted(lr.fit(assembled(df, features)), features)


def fit_forest(df: DataFrame, features: list[str], label: str, seed: int, trees=200, depth=20, leaf=2):
    from pyspark.ml.regression import RandomForestRegressor

    rf = RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return Fitted(rf.fit(assembled(df, features)), features)


def fit_boosted(df: DataFrame, features: list[str], label: str, seed: int, rounds=500, depth=6, step=0.05, held_out: str | None = None):
    """Boosted trees; ``held_out`` names a boolean column of rows that decide early stopping."""
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    if held_out:
        gbt = gbt.setValidationIndicatorCol(held_out)
    return Fitted(gbt.fit(assembled(df, features)), features)


def probe_r2(df: DataFrame, by: list[str], vec, targets: list[str], ridge: float = 1e-3) -> DataFrame:
    """Mean in-sample R2 over target coordinates, intercept penalised like the rest."""
    width = df.select(F.max(F.size(vec))).first()[0]
    g = gram(df, by, vec, targets)
    w = ridge_weights(g, by, width, len(targets), [ridge], penalize_one=True)
    per = r2_from_gram(w, g, by, width)
    return per.groupBy(*by).agg(F.avg("r2").alias("probe_r2")) if by else per.agg(F.avg("r2").alias("probe_r2"))


def separability(df: DataFrame, key: str, vec: str, cls: str, k: int = 5, seed=0, ridge: float = 1.0) -> DataFrame:
    """Mean held-out accuracy of a one-against-rest ridge classifier over stratified folds; NULL for
    fewer than two classes.

    Products are summed per fold once, and the vectors per fold and class: the +-1 targets of a class
    follow from its sum and the total.  The training table of a fold is the total less its own."""
    from screenloom.functions.ordered import ordinal
    from screenloom.operators.resample import stratified_folds

    width = df.select(F.max(F.size(vec))).first()[0]
    ids = durable(ordinal(df.select(cls).distinct(), [], [cls], "_c").select(cls, F.col("_c").cast("int").alias("_c")))
    n = ids.count()
    rows = stratified_folds(df.select(key, cls, vec), cls, key, k, seed)
    whole = F.concat(F.col(vec).cast("array<double>"), F.array(F.lit(1.0)))
    own = rows.groupBy("fold", cls).agg(vector_to_array(Summarizer.sum(array_to_vector(whole))).alias("_s"))
    per_class = own.join(ids, cls).select("fold", F.col("_c").alias("j"), F.posexplode("_s").alias("i", "s"))

    def rest(t: DataFrame) -> DataFrame:
        total = t.groupBy("i", "j").agg(F.sum("s").alias("_all"))
        spread = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        return spread.join(t, ["fold", "i", "j"], "left").select("fold", "i", "j", (F.col("_all") - F.coalesce("s", F.lit(0.0))).alias("s"))

    g = rest(gram(rows, ["fold"], F.col(vec)))
    ones = g.where(F.col("j") == width).select("fold", "i", F.col("s").alias("_t"))
    targets = rest(per_class).join(ones, ["fold", "i"]).select("fold", "i", (F.col("j") + width + 1).alias("j"), (2 * F.col("s") - F.col("_t")).alias("s"))
    w = ridge_weights(g.unionByName(targets), ["fold"], width, n, [ridge], penalize_one=True)
    per_fold = w.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("target", "w"))).alias("ws"))
    scored = rows.withColumn("_v", whole).join(broadcast_if_small(per_fold), "fold").select(
        "fold", cls,
        F.transform("ws", lambda t: F.aggregate(F.zip_with("_v", t["w"], lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)).alias("score"),
    )
    picked = scored.join(ids, cls).withColumn("_hit", F.array_position("score", F.array_max("score")) - 1 == F.col("_c"))
    acc = picked.groupBy("fold").agg(F.avg(F.col("_hit").cast("double")).alias("acc"))
    mean = F.when(F.lit(n > 1), F.avg("acc"))
    return acc.agg(mean.alias("accuracy"), F.count(F.lit(1)).alias("n_folds"), F.lit(1.0 / max(n, 1)).alias("chance"))
