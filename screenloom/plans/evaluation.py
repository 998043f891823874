"""Locked evaluation: fit on training rows, choose on validation, freeze, score the rest once."""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from screenloom.functions import stats as S
from screenloom.functions.hashing import uniform
from screenloom.operators import boosting, features as X, linear as L, metrics as M
from screenloom.operators.audit import Forbidden, portable_digest
from screenloom.session import durable


class Frozen:
    """The written choice per arm and its digest, taken before any test row is scored.  Test rows are
    scored only through this object, and their scores carry the digest of the choice they used."""

    def __init__(self, table: DataFrame):
        self.table = durable(table)
        self.digest = self.content()

    def content(self) -> str:
        """Digest of the table as it lies in the folder now."""
        row = portable_digest(self.table, ["arm", "selected"]).first()
        return "|".join(str(x) for x in row)

    def keep(self, scores: DataFrame, arm="arm", family="family") -> DataFrame:
        chosen = self.table.select(arm, F.col("selected").alias(family))
        return scores.join(F.broadcast(chosen), [arm, family], "left_semi").withColumn("frozen", F.lit(self.digest))


def validation_table(scores: DataFrame) -> DataFrame:
    """arm, family, seed, r2 on validation rows; other splits are refused, not skipped."""
    other = scores.where(F.col("split") != "val").limit(1).count()
    if other:
        raise Forbidden("the selection reads validation rows only")
    return scores.groupBy("arm", "family", "seed").agg(S.r2("y", "yhat").alias("r2"))


def freeze(val: DataFrame) -> Frozen:
    summary = M.seed_summary(val, ["arm", "family"], "r2")
    return Frozen(M.selection_table(summary, "arm", "family", "mean", "sd"))


def test_table(frozen: Frozen, scores: DataFrame) -> DataFrame:
    """Metrics of the chosen family per arm: each seed once, then mean and spread over seeds."""
    kept = frozen.keep(scores.where(F.col("split") == "test"))
    keys = ["arm", "family", "seed", "frozen"]
    per = kept.groupBy(*keys).agg(S.r2("y", "yhat").alias("r2")).join(
        M.spearman(kept, keys, {"rho": ("y", "yhat")}), keys)
    return per.groupBy("arm", "family", "frozen").agg(
        F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_sd"), F.avg("rho").alias("spearman_mean"),
        F.stddev_samp("rho").alias("spearman_sd"), F.count(F.lit(1)).alias("n_seeds"),
    )


def sweep(rows: DataFrame, arms: dict[str, list[str]], families: dict, seeds: list[int], key: str, label: str, seedless: tuple[str, ...] = ()) -> DataFrame:
    """arm, family, seed, split, key, y, yhat for every arm, family and seed.

    An arm is a list of columns, numbers or vectors; they are joined to one block, scaled by the training
    rows, and handed to each family, a function (training rows, features, label, seed) -> model.  Models
    are few; the rows they score are not.  Families named in ``seedless`` draw nothing, so one fit and one scoring serve all seeds."""
    parts = []
    for arm, feats in arms.items():
        kinds = dict(rows.dtypes)
        block = F.concat(*[F.col(f).cast("array<double>") if kinds[f].startswith("array") else F.array(F.col(f).cast("double")) for f in feats])
        narrow = rows.select(F.col(key).alias("key"), "split", F.col(label).alias("y"), block.alias("_arm"))
        if narrow.where(F.col("split") == "train").isEmpty():
            continue
        scaled = durable(X.apply_block_scaler(narrow, X.fit_block_scaler(narrow, "_arm"), "_arm"))
        train, rest = scaled.where(F.col("split") == "train"), scaled.where(F.col("split") != "train")
        for family, fit in families.items():
            for served in [seeds] if family in seedless else [[seed] for seed in seeds]:
                model = fit(train, ["_arm"], "y", served[0])
                if model is None:
                    continue
                parts.append(model.transform(rest).select(
                    F.lit(arm).alias("arm"), F.lit(family).alias("family"), F.explode(F.array(*[F.lit(seed) for seed in served])).alias("seed"), "split",
                    "key", "y", F.col("prediction").alias("yhat")))
    if not parts:
        kinds = dict(rows.dtypes)
        return rows.sparkSession.createDataFrame(
            [], f"arm string, family string, seed int, split string, key {kinds[key]}, y {kinds[label]}, yhat double")
    return functools.reduce(DataFrame.unionByName, parts)


def sweep_boosted(rows: DataFrame, arms: dict[str, list[str]], seeds: list[int], key: str, label: str, share: float = 0.1, **sizes) -> DataFrame:
    """As ``sweep`` for boosted trees, whose arms and seeds are fitted together.  Each seed draws its own ``share`` of the
    training rows, which decide when to stop; features are not scaled.  ``sizes`` go to ``boosting.fit``."""
    kinds = dict(rows.dtypes)
    blocks = [F.concat(*[F.col(f).cast("array<double>") if kinds[f].startswith("array") else F.array(F.col(f).cast("double")) for f in feats]) for feats in arms.values()]
    each = F.array(*[F.struct(F.lit(a).alias("arm"), b.alias("_x")) for a, b in zip(arms, blocks)])
    # the blocks are written once; seeds are added as they are read
    long = durable(rows.select(F.col(key).alias("key"), "split", F.col(label).alias("y"), F.inline(each)))
    long = long.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    train = long.where(F.col("split") == "train").withColumn("_held", uniform(F.col("seed"), "key") < share)
    model = boosting.fit(train, ["arm", "seed"], "_x", "y", "_held", **sizes)
    scored = model.transform(long.where(F.col("split") != "train"), "yhat").where(F.col("yhat").isNotNull())
    return scored.select("arm", F.lit("boosted").alias("family"), "seed", "split", "key", "y", "yhat")


def probe_grid(train: DataFrame, val: DataFrame, arms: dict, width: dict, targets: list[str], alphas=L.ALPHAS, repeats: int = 1) -> DataFrame:
    """Validation R2 of every (input, target, alpha): one pass over the rows per input, whatever the
    number of targets and penalties.  Repeats re-run the whole pass."""
    parts = []
    for rep in range(1, repeats + 1):
        for arm, vec in arms.items():
            gt, gv = L.gram(train, [], vec, targets), L.gram(val, [], vec, targets)
            w = L.ridge_weights(gt, [], width[arm], len(targets), alphas, penalize_one=False)
            parts.append(L.r2_from_gram(w, gv, [], width[arm]).select(
                F.lit(arm).alias("arm"), "target", "alpha", F.lit(rep).alias("repeat"), "r2"))
    return functools.reduce(DataFrame.unionByName, parts)


def zero_shot(model, stats: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Score another screen with the stored scaler and model; nothing is fitted here."""
    return model.transform(X.apply_scaler(rows, stats, features))


def reproduction_gate(measured: DataFrame, expected: DataFrame, key: str, tolerance: float = 0.005) -> DataFrame:
    """pass per item: a single value within the tolerance; several seeds within two SDs of their mean
    or with the expected value inside their range."""
    per = measured.groupBy(key).agg(
        F.avg("r2").alias("mean"), F.stddev_samp("r2").alias("sd"), F.min("r2").alias("lo"), F.max("r2").alias("hi"), F.count("r2").alias("k"))
    gap = F.abs(F.col("mean") - F.col("expected"))
    within = F.when(F.col("k") == 1, gap <= tolerance).otherwise(
        (gap <= 2 * F.col("sd")) | F.col("expected").between(F.col("lo"), F.col("hi")))
    return expected.join(per, key, "left").select(
        key, "expected", "mean", "sd", "k", F.coalesce(within, F.lit(False)).alias("pass"))


def overall(gate: DataFrame) -> DataFrame:
    """One verdict over all items: reproduced only when every one passes and there is one."""
    return gate.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("pass").alias("n_passed"),
        (F.count_if("pass") == F.count(F.lit(1))).alias("_all"),
    ).select("n_items", "n_passed", (F.col("_all") & (F.col("n_items") > 0)).alias("pass"))


def objective(spark: SparkSession, terms: dict[str, DataFrame | None], weights: dict[str, float]) -> DataFrame:
    """Each loss term, disabled ones as zero, and their weighted total in one row.  A term is a
    one-row, one-column frame."""
    row = spark.range(1).select(*[
        (t.scalar() if t is not None else F.lit(0.0)).cast("double").alias(name) for name, t in terms.items()])
    total = functools.reduce(lambda a, b: a + b, [F.lit(float(weights.get(n, 1.0))) * F.col(n) for n in terms])
    return row.withColumn("total", total)
