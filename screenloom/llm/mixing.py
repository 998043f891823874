"""Mixing sources to target weights.

A tree domain - language - source carries the weights.  A node can hold no more tokens than its leaves offer in the allowed
epochs; what it cannot hold goes to its siblings in proportion to their weights, and only what all of them cannot hold goes
up.  Each leaf then takes whole epochs and, of one more epoch in a seeded order, the shortest run of documents from the front
that reaches its budget.  Only DataFrame functions; all amounts are whole numbers.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.session import durable

LEVELS = ("domain", "lang", "source")
#: Share of all available tokens (one epoch each) to select, in percent, and epochs at most for any document.
BUDGET_PERCENT, MOST_EPOCHS = 60, 3
#: Slices of a leaf's seeded order; only one slice of each leaf is sorted.
SLICES = 4096
SEED = "mix-1"
#: Target weights of the registered query and of the pipeline; what is not named weighs 1.  Sources go 1, 2, 3, 1, 2, 3 and so on.
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 3, "fr": 2, "es": 2},
    "source": {f"src{i}": 1 + i % 3 for i in range(20)},
}


def domain_of(source: Column) -> Column:
    """A fixed grouping of sources into four domains, for tables that name none."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.encode(F.coalesce(source.cast("string"), F.lit("")), "UTF-8")), F.lit(4)).cast("string"))


def n_tokens(text: Column) -> Column:
    """Runs of non-space bytes; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def shares(leaves: DataFrame, levels: tuple[str, ...], budget: int, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """``leaves`` (the levels and ``capacity``) with ``share``: the tokens that each leaf is to give.

    ``weights`` holds whole numbers from 1 to 1000 by level and name; a name without one weighs 1.  At every node, children
    are filled in the order of capacity over weight, each as far as it goes while the rest could still fill up evenly.
    """
    weights = weights or {}
    nodes = leaves.agg(F.least(F.coalesce(F.sum("capacity"), F.lit(0)), F.lit(budget)).alias("share"))
    above: list[str] = []
    for level in levels:
        path = [*above, level]
        named = reduce(
            lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), weights.get(level, {}).items(), F.when(F.lit(False), 1)
        ).otherwise(1)
        children = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", named.cast("bigint"))
        if above:
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above]
            children = children.join(nodes.select(*[F.col(c).alias(f"_{c}") for c in above], "share"), reduce(lambda a, b: a & b, same))
            children = children.drop(*[f"_{c}" for c in above])
        else:
            children = children.crossJoin(F.broadcast(nodes))  # one row
        group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        earlier = group.orderBy((F.col("capacity") / F.col("weight")), level).rowsBetween(Window.unboundedPreceding, -1)
        children = children.select(
            "*", F.sum("weight").over(group).alias("all_w"),
            F.coalesce(F.sum("capacity").over(earlier), F.lit(0)).alias("cap_before"),
            F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("w_before"),
        )
        full = F.col("cap_before") * F.col("weight") + F.col("capacity") * (F.col("all_w") - F.col("w_before")) <= F.col("share") * F.col("weight")
        children = children.withColumn("full", full)
        children = children.select(
            "*", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)).alias("cap_full"),
            F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(group), F.lit(0)).alias("w_full"),
        )
        part = F.expr("(weight * (share - cap_full)) div nullif(all_w - w_full, 0)")
        nodes = children.select(*path, F.when(F.col("full"), F.col("capacity")).otherwise(part).alias("share"))
        above = path
    return nodes


def _spot(docs: DataFrame, levels: tuple[str, ...], seed: str) -> tuple[Column, Column, Column, Column]:
    """Leaf, token count, digest and slice of a row."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))))
    level = lambda c: domain_of(docs["source"]) if c == "domain" and c not in docs.columns else docs[c]
    leaf = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), level(c).cast("string")), F.lit("-")) for c in levels])
    return leaf, n_tokens(docs["text"]), digest, F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def _place() -> Column:
    return F.struct("place", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "n_tokens")


def _cuts(rows: DataFrame, levels: tuple[str, ...], weights, budget_percent: int, most_epochs: int) -> DataFrame:
    """``leaf, whole, last``: full epochs of each leaf, and the place of the last row that one more epoch takes."""
    # one row per leaf and slice: the leaf's order is cut by the first digits of the digest
    sums = durable(rows.groupBy("leaf", "slice", *levels).agg(F.sum("n_tokens").alias("tokens")))
    leaves = sums.groupBy("leaf", *levels).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    leaf = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in levels])
    capacity = leaves.withColumn("capacity", F.col("tokens") * most_epochs)
    share = shares(capacity, levels, int(total) * budget_percent // 100, weights).select(leaf.alias("leaf"), "share")
    parts = durable(leaves.join(share, "leaf").select(
        "leaf", F.expr("cast(share div tokens as int)").alias("whole"), F.expr("share % tokens").alias("rest")
    ))
    before = Window.partitionBy("leaf").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("leaf", "slice", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).join(parts, "leaf")
    # the last slice that is begun: all before it are taken whole, so only its rows are put in order
    cut = begun.where(F.col("before") < F.col("rest")).groupBy("leaf").agg(F.max(F.struct("slice", (F.col("rest") - F.col("before")).alias("left"))).alias("c"))
    cut = broadcast_if_small(durable(cut.select("leaf", "c.slice", "c.left")))
    run = Window.partitionBy("leaf").orderBy("key")
    upto = F.sum("n_tokens").over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("n_tokens").over(run.rangeBetween(Window.currentRow, Window.currentRow))
    ordered = rows.join(cut, ["leaf", "slice"]).select("leaf", "n_tokens", "left", _place().alias("key"))
    taken = ordered.withColumn("taken", upto - same < F.col("left")).where("taken")
    last = taken.groupBy("leaf").agg(F.max("key").alias("last"))
    return durable(parts.select("leaf", "whole").join(last, "leaf", "left"))


def _epochs() -> Column:
    return (F.col("whole") + F.coalesce((_place() <= F.col("last")).cast("int"), F.lit(0))).cast("int")


def _rows(docs: DataFrame, levels: tuple[str, ...], seed: str) -> DataFrame:
    leaf, tokens, digest, spot = _spot(docs, levels, seed)
    own = [domain_of(docs["source"]).alias(c) if c == "domain" and c not in docs.columns else docs[c] for c in levels]
    rows = docs.select(docs["doc_id"], *own, leaf.alias("leaf"), tokens.alias("n_tokens"), digest.alias("place"), spot.alias("slice"))
    return durable(rows.where(F.col("n_tokens") > 0))


def mix(
    docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] | None = None,
    budget_percent: int = BUDGET_PERCENT, most_epochs: int = MOST_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """``doc_id``, the levels, ``n_tokens`` and ``epochs`` (how often the document is taken) of every selected row.

    ``docs`` needs ``doc_id``, ``text`` and the levels (a missing ``domain`` is derived from ``source``); other columns are
    ignored.  The order inside a leaf is that of MD5 of seed and ``doc_id``, then ``doc_id``, then the token count; a row is
    taken in the last, partial epoch if the rows before it do not yet reach what is left.  So a leaf gives its share, or at
    most one document more.  A null level is a leaf of its own.  Texts without tokens (null, empty, blank) are never
    selected.  A null ``doc_id`` sorts as the empty text; rows equal in id and token count are taken together.  An empty table gives
    no rows.
    """
    rows = _rows(docs, levels, seed)
    cuts = broadcast_if_small(_cuts(rows, levels, weights, budget_percent, most_epochs))
    return rows.join(cuts, "leaf").select("doc_id", *levels, "n_tokens", _epochs().alias("epochs")).where("epochs > 0")


def mixed(
    docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] | None = None,
    budget_percent: int = BUDGET_PERCENT, most_epochs: int = MOST_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """The rows that :func:`mix` selects with all their columns, texts included, and ``epochs`` (an earlier column of that name
    goes).  Texts are not shuffled: each row compares its place with its leaf's last one."""
    cuts = broadcast_if_small(_cuts(_rows(docs, levels, seed), levels, weights, budget_percent, most_epochs))
    leaf, tokens, digest, _ = _spot(docs, levels, seed)
    keep = [c for c in docs.columns if c.lower() != "epochs"]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["doc_id"], leaf.alias("leaf"), tokens.alias("n_tokens"), digest.alias("place"))
    chosen = rows.where(F.col("n_tokens") > 0).join(cuts, "leaf").select("row", _epochs().alias("epochs")).where("epochs > 0")
    return chosen.select(*[F.col("row")[c].alias(c) for c in keep], "epochs")
