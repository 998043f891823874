"""Two-sample Anderson-Darling labels and one-way variance components."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.functions.hashing import order_key
from screenloom.functions.ordered import GROUP_LIMIT, largest_group, running
from screenloom.functions.sizes import broadcast_if_small
from screenloom.session import durable

EULER = 0.5772156649015329


# H_n and the sum of 1/i^2: summed directly up to 40, by their asymptotic series beyond.
_H = """CASE WHEN {n} <= 40
  THEN aggregate(sequence(1, cast(least(greatest({n}, 1), 40) AS int)), 0D, (a, i) -> a + 1D / i)
  ELSE ln({n}) + {euler}D + 1 / (2D * {n}) - 1 / (12D * {n} * {n}) + 1 / (120D * pow({n}, 4)) - 1 / (252D * pow({n}, 6)) END"""
_H2 = """CASE WHEN {n} <= 40
  THEN aggregate(sequence(1, cast(least(greatest({n}, 1), 40) AS int)), 0D, (a, i) -> a + 1D / (i * i))
  ELSE {zeta2}D - 1D / {n} + 1 / (2D * {n} * {n}) - 1 / (6D * pow({n}, 3)) + 1 / (30D * pow({n}, 5)) - 1 / (42D * pow({n}, 7)) END"""


def _with_sigma(df: DataFrame) -> DataFrame:
    """Null standard deviation of the two-sample statistic for sizes n1 and n2.

    The double sum g of the published variance equals H2(N-1) - 2 H(N-1)/N, so no table of sample
    sizes is needed.  h and g become columns first, so that each is computed once."""
    df = df.selectExpr("*", "cast(n1 + n2 AS double) AS _n", "1D / n1 + 1D / n2 AS _hs")
    df = df.selectExpr("*", _H.format(n="(_n - 1)", euler=EULER) + " AS _h", _H2.format(n="(_n - 1)", zeta2=math.pi**2 / 6) + " AS _h2")
    df = df.selectExpr("*", "_h2 - 2 * _h / _n AS _g")
    a = "((4 * _g - 6) + (10 - 6 * _g) * _hs)"
    b = "((2 * _g - 4) * 4 + 16 * _h + (2 * _g - 14 * _h - 4) * _hs - 8 * _h + 4 * _g - 6)"
    c = "((6 * _h + 2 * _g - 2) * 4 + (4 * _h - 4 * _g + 6) * 2 + (2 * _h - 6) * _hs + 4 * _h)"
    d = "((2 * _h + 6) * 4 - 8 * _h)"
    top = f"((({a} * _n + {b}) * _n + {c}) * _n + {d})"
    df = df.selectExpr("*", f"sqrt({top} / ((_n - 1) * (_n - 2) * (_n - 3))) AS _sigma")
    return df.drop("_n", "_hs", "_h", "_h2", "_g")


def anderson_darling(hist: DataFrame, keys: list[str], limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Statistic and label per group from ``(keys, value, f1, f2)``: how often each distinct value
    occurs in either sample.

    Groups are dropped when a sample has fewer than two values, three or fewer are pooled, or all
    values are equal: their label is undefined."""
    run = running(hist, keys, ["value"], ["f1", "f2"], limit)
    n1, n2 = F.col("f1_total"), F.col("f2_total")
    n = (n1 + n2).cast("double")
    tie = F.col("f1") + F.col("f2")
    mid = F.col("f1_before") + F.col("f2_before") + tie / F.lit(2.0)
    mid1 = F.col("f1_before") + F.col("f1") / F.lit(2.0)
    gap = n * mid1 - n1 * mid
    term = F.try_divide(tie / n * gap * gap, mid * (n - mid) - n * tie / F.lit(4.0))
    agg = run.select(*keys, n1.alias("n1"), n2.alias("n2"), term.alias("_t")).groupBy(*keys).agg(
        F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.sum("_t").alias("_s"), F.count(F.lit(1)).alias("_k")
    )
    # the test runs on counts before the formulas: a filter on the label would copy them
    agg = agg.where((F.col("n1") >= 2) & (F.col("n2") >= 2) & (F.col("n1") + F.col("n2") > 3) & (F.col("_k") >= 2))
    out = _with_sigma(agg).selectExpr(
        *keys, "n1", "n2",
        "((n1 + n2 - 1D) / (n1 + n2) * (1D / n1 + 1D / n2) * _s - 1) / _sigma AS stat",
    )
    return out.selectExpr("*", "log1p(greatest(0D, stat)) AS y")


def own_gene_histogram(norm: DataFrame, cells: DataFrame, sizes: DataFrame, own: Column, keys: list[str], control: str) -> DataFrame:
    """(keys, value, f1, f2) of each group and its batch's controls on the group's own gene.

    One pass over the values keeps each treated cell's own gene and, for controls, the genes that
    are some group's own, reduced to counts per distinct value and written once.  Controls are thus
    one histogram per (batch, gene) before any group sees them; cells without an entry are zeros."""
    groups = sizes.select(*keys, "n_cells", own.alias("gene_idx"))
    none = F.lit(0).cast("bigint")
    ctrl = F.col("target") == control
    entries = (
        norm.join(groups.select("gene_idx").distinct(), "gene_idx", "left_semi")
        .join(cells.select("cell_id", *keys), "cell_id")
        .where(ctrl | (F.col("gene_idx") == own))
    )
    wide = [(F.col(k) if k in ("batch", "target") else F.when(~ctrl, F.col(k))).alias(k) for k in keys]
    hist = durable(entries.groupBy(*wide, "gene_idx", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("f")))
    t = hist.where(~ctrl).join(groups.select(*keys), keys, "left_semi").select(
        *keys, "value", F.col("f").alias("f1"), none.alias("f2")
    )
    c = hist.where(ctrl).select("batch", "gene_idx", "value", F.col("f").alias("f2"))
    controls = cells.where(ctrl)
    c_for = groups.select(*keys, "gene_idx").join(c, ["batch", "gene_idx"]).select(
        *keys, "value", none.alias("f1"), "f2"
    )
    n_ctrl = controls.groupBy("batch").agg(F.count(F.lit(1)).alias("n_ctrl"))
    zeros = groups.join(n_ctrl, "batch").select(
        *keys, F.lit(0.0).alias("value"), F.col("n_cells").alias("f1"), F.col("n_ctrl").alias("f2")
    )
    return _with_zeros(t.unionByName(c_for), zeros, keys)


def _with_zeros(stored: DataFrame, zeros: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram of all cells: each stored entry adds to its value and takes from the zeros, which start at all cells."""
    moves = F.explode(F.array(
        F.struct(F.col("value").alias("value"), F.col("f1").alias("f1"), F.col("f2").alias("f2")),
        F.struct(F.lit(0.0).alias("value"), (-F.col("f1")).alias("f1"), (-F.col("f2")).alias("f2")),
    )).alias("m")
    stacked = stored.select(*keys, moves).select(*keys, "m.*").unionByName(zeros)
    return stacked.groupBy(*keys, "value").agg(F.sum("f1").alias("f1"), F.sum("f2").alias("f2")).where("f1 + f2 > 0")


def label_groups(norm, cells, sizes, own: Column, keys: list[str], control: str) -> DataFrame:
    """keys, n1, n2, stat, y; groups without a label are dropped.

    A pooled group never exceeds its batch, so the size check counts cells, not histograms."""
    limit = None if largest_group(cells, ["batch"]) <= GROUP_LIMIT else 0
    hist = own_gene_histogram(norm, cells, sizes, own, keys, control)
    return anderson_darling(hist, keys, limit)


#: Draws held in one word of a cell's bit mask.
WORD = 62


def _smallest_keys(df: DataFrame, by: list[str], n: int, draws: int, seed) -> DataFrame:
    """cell_id, by, draw, o: in each draw rows among which are the n smallest keys of every group of at least n cells.

    Keys are evenly spread, so those below a bound hold the n smallest of a group of known size and hardly more: a bound of eight
    standard deviations and 32 cells above n.  A group that has fewer than n below its bound in some draw comes whole in that
    draw, so the choice of the bound decides what is kept aside, never what is drawn."""
    spare = n + 8 * math.sqrt(n) + 32
    full = df.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n)
    # the key's first eight hexadecimal digits; g lies above all digits
    bound = F.when(F.col("k") > spare, F.lpad(F.lower(F.hex(F.floor(F.lit(spare * 2.0**32) / F.col("k")))), 8, "0")).otherwise("g")
    full = broadcast_if_small(durable(full.select(*by, bound.alias("bound"))))
    draw = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    keyed = df.select("cell_id", *by).join(full, by).select("*", draw).withColumn("o", order_key(seed, F.col("draw"), F.col("cell_id")))
    below = durable(keyed.where("o < bound").drop("bound"))
    enough = below.groupBy(*by, "draw").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n)
    short = durable(full.select(*by, draw).join(enough, [*by, "draw"], "left_anti"))
    if short.isEmpty():
        return below
    whole = keyed.drop("bound").join(broadcast_if_small(short), [*by, "draw"], "left_semi")
    return below.join(enough, [*by, "draw"], "left_semi").unionByName(whole)


def draw_masks(df: DataFrame, by: list[str], n: int, draws: int, seed) -> DataFrame:
    """``cell_id``, ``by`` and ``w0, w1, ...``: bit d - 1 of the words says whether draw d holds the cell.

    A draw keeps the first n cells of each group in keyed random order; groups of fewer cells are left out and cells in
    no draw have no row.  Only keys that can be among the first n are put in order; see :func:`_smallest_keys`."""
    w = Window.partitionBy(*by, "draw").orderBy("o", "cell_id")
    d = _smallest_keys(df, by, n, draws, seed).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    bit = f"shiftleft(1L, cast((draw - 1) % {WORD} AS int))"
    words = [F.expr(f"bit_or(if(div(draw - 1, {WORD}) = {i}, {bit}, 0L))").alias(f"w{i}") for i in range(-(-draws // WORD))]
    return d.groupBy("cell_id", *by).agg(*words)


def size_controlled_labels(
    norm: DataFrame, treated: DataFrame, controls: DataFrame, own: Column, keys: list[str],
    n_treated: int, n_control: int, draws: int, seed,
) -> DataFrame:
    """Labels from ``draws`` repeated fixed-size subsamples of both sides, one row per draw.

    Cells carry a bit mask of the draws that hold them, so the values are read once: every distinct value of a group, or of
    a batch's controls on some group's own gene, becomes one vector of counts by draw.  Groups with fewer than
    ``n_treated`` cells, or fewer than ``n_control`` controls in their batch, have no label."""
    t = draw_masks(treated, keys, n_treated, draws, seed).withColumn("is_treated", F.lit(True))
    c = draw_masks(controls, ["batch"], n_control, draws, seed).withColumn("is_treated", F.lit(False))
    sized = [
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n).select(*by)
        for df, by, n in ((treated, keys, n_treated), (controls, ["batch"], n_control))
    ]
    groups = sized[0].join(sized[1], "batch", "left_semi").withColumn("gene_idx", own)
    members = t.withColumn("own", own).unionByName(c, allowMissingColumns=True)
    entries = (
        norm.join(groups.select("gene_idx").distinct(), "gene_idx", "left_semi")
        .join(members, "cell_id")
        .where(~F.col("is_treated") | (F.col("gene_idx") == F.col("own")))
    )
    bits = [F.expr(f"sum(shiftright(w{i // WORD}, {i % WORD}) & 1L)") for i in range(draws)]
    hist = durable(entries.groupBy("is_treated", *keys, "gene_idx", F.col("v").alias("value")).agg(F.array(*bits).alias("f")))

    none = F.lit(0).cast("bigint")
    by_draw = F.posexplode("f").alias("at", "n")
    on_t = hist.where("is_treated").join(groups.select(*keys), keys, "left_semi").select(*keys, "value", by_draw).where("n > 0").select(
        *keys, (F.col("at") + 1).alias("draw"), "value", F.col("n").alias("f1"), none.alias("f2")
    )
    on_c = groups.join(hist.where(~F.col("is_treated")).select("batch", "gene_idx", "value", "f"), ["batch", "gene_idx"])
    on_c = on_c.select(*keys, "value", by_draw).where("n > 0").select(
        *keys, (F.col("at") + 1).alias("draw"), "value", none.alias("f1"), F.col("n").alias("f2")
    )
    zeros = groups.select(
        *keys, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), F.lit(0.0).alias("value"),
        F.lit(n_treated).cast("bigint").alias("f1"), F.lit(n_control).cast("bigint").alias("f2"),
    )
    # a group holds at most n_treated + n_control cells: no size check needed
    return anderson_darling(_with_zeros(on_t.unionByName(on_c), zeros, [*keys, "draw"]), [*keys, "draw"], limit=None)


def summarize_draws(labels: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("y", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.75, 0.95)])).alias("q")
    return labels.groupBy(*keys).agg(
        F.avg("y").alias("y_mean"), F.stddev_samp("y").alias("y_std"), q, F.count("y").alias("n_valid")
    ).select(
        *keys, "y_mean", "y_std", F.col("q")[0].alias("y_p5"), F.col("q")[3].alias("y_p95"),
        (F.col("q")[2] - F.col("q")[1]).alias("y_iqr"), "n_valid",
    )


def variance_components(df: DataFrame, value: str, axes: list[str], by: list[str]) -> DataFrame:
    """One-way method-of-moments components per ``by`` group and grouping axis.

    Nothing is clipped: a negative between-variance or ICC is reported as it is.  Approximate
    effective sizes are NULL, and flagged, when the design effect is not positive."""
    axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("grp")) for a in axes])).alias("x")
    rows = df.select(*by, F.col(value).alias("t"), axis).select(*by, "t", "x.axis", "x.grp")
    keys = [*by, "axis"]
    groups = rows.groupBy(*keys, "grp").agg(
        F.count("t").cast("double").alias("m"), F.avg("t").alias("mu"), F.var_pop("t").alias("v")
    )
    total = rows.groupBy(*keys).agg(F.avg("t").alias("tbar"), (F.var_pop("t") * F.count("t")).alias("total_ss"))
    g = groups.join(total, keys).groupBy(*keys).agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("m") * F.col("m")).alias("m2"),
        F.min("m").alias("size_min"), F.max("m").alias("size_max"), F.percentile("m", F.lit(0.5)).alias("size_median"),
        F.sum(F.col("m") * (F.col("mu") - F.col("tbar")) * (F.col("mu") - F.col("tbar"))).alias("ssb"),
        F.sum(F.col("v") * F.col("m")).alias("ssw"), F.max("total_ss").alias("total_ss"),
    )
    c = F.col
    g = (
        g.withColumn("msb", F.try_divide(c("ssb"), F.when(c("k") > 1, c("k") - 1)))
        .withColumn("msw", F.try_divide(c("ssw"), F.when(c("n") > c("k"), c("n") - c("k"))))
        .withColumn("m0", F.try_divide(c("n") - c("m2") / c("n"), F.when(c("k") > 1, c("k") - 1)))
        .withColumn("var_between", F.try_divide(c("msb") - c("msw"), c("m0")))
        .withColumn("icc", F.try_divide(c("var_between"), c("var_between") + c("msw")))
        .withColumn("eta_squared", F.try_divide(c("ssb"), c("total_ss")))
        .withColumn("de_arith", 1 + (c("n") / c("k") - 1) * c("icc"))
        .withColumn("de_weighted", 1 + (c("m2") / c("n") - 1) * c("icc"))
    )
    for kind in ("arith", "weighted"):
        de = c(f"de_{kind}")
        g = g.withColumn(f"approx_n_{kind}", F.when(de > 0, c("n") / de)).withColumn(
            f"interpretable_{kind}", F.coalesce(de > 0, F.lit(False))
        )
    return g.drop("m2")
