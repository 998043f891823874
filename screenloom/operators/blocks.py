"""Kernel statistics over all row pairs of a group, computed block against block.

Their value is a sum over every pair, so the work is quadratic; pairs themselves are never written.
Rows are packed into blocks of bounded size and the blocks dealt to parts.  One task holds the blocks of two parts, lets
each of them meet its partners once and adds up what the pairs give (sums, or one number per row).  A row travels once
for each part, and there are ``PARTS`` parts until one would hold more than a task should, so that what is moved grows
with the rows and not with their square.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from screenloom.operators.pairs import context_pairs
from screenloom.session import durable

BLOCK = 1024
BINS = 2048
#: Parts to which blocks are dealt while none holds too much: 136 pairs of parts for the cores.
PARTS = 16
#: Vector components, and blocks, that a part may hold.
COMPONENTS, BLOCKS_IN_PART = 4_000_000, 64
#: Side of the tiles in which distances are made, so that a tile stays in a core's cache.
TILE = 256
#: Coarse bins that the sweep around a guessed median may cut finely, and blocks for each context from which a guess pays.
GUESSED, BLOCKS_TO_GUESS = 64, 8


def _d2(a, b) -> np.ndarray:
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    both = a @ b.T
    both *= 2.0
    out -= both
    return np.maximum(out, 0.0, out=out)


def _tiles(a: np.ndarray, b: np.ndarray):
    """i, j and the squared distances of the rows from i on of ``a`` and from j on of ``b``, for each tile."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    for i in range(0, len(a), TILE):
        twice = 2.0 * a[i : i + TILE]
        for j in range(0, len(b), TILE):
            out = np.add.outer(na[i : i + TILE], nb[j : j + TILE])
            out -= twice @ b[j : j + TILE].T
            yield i, j, np.maximum(out, 0.0, out=out)


def pack(df: DataFrame, context: str, key: str, vec: str, size: int = BLOCK) -> DataFrame:
    """ctx, gid, first, last, n_ctx, keys, vecs: blocks of about ``size`` rows, numbered through all contexts, written once;
    ``first`` and ``last`` are the numbers between which the block's own context lies.  Keys are unique, so
    hashing them spreads any context evenly over its blocks."""
    per = df.groupBy(F.col(context).alias("ctx")).agg(F.count(F.lit(1)).alias("n_ctx"))
    per = per.withColumn("nb", F.ceil(F.col("n_ctx") / F.lit(size)).cast("bigint"))
    # one row per context
    w = Window.partitionBy(F.lit(0)).orderBy("ctx")
    per = per.withColumn("first", F.sum("nb").over(w) - F.col("nb"))
    rows = df.select(F.col(context).alias("ctx"), F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).join(per, "ctx")
    gid = F.col("first") + F.pmod(F.xxhash64("k"), F.col("nb"))
    return durable(rows.groupBy("ctx", gid.alias("gid"), "n_ctx", "first", (F.col("first") + F.col("nb") - 1).alias("last")).agg(
        F.sort_array(F.collect_list(F.struct("k", "v"))).alias("rows")
    ).select("ctx", "gid", "n_ctx", "first", "last", F.col("rows.k").alias("keys"), F.col("rows.v").alias("vecs")))


class Block:
    """A block inside a task: context, number, place in the task's table, rows as a matrix."""

    def __init__(self, table, at: int):
        self.ctx, self.gid, self.part, self.at = (table["ctx"][at].as_py(), table["gid"][at].as_py(), table["part"][at].as_py(), at)
        vecs = table["vecs"][at].values
        self.x = np.array(vecs.flatten(), dtype=np.float64).reshape(len(vecs), -1)

    def keys(self, table) -> np.ndarray:
        return np.array(table["keys"][self.at].values.to_pylist())


def meet(blocks: DataFrame, across: bool, work, schema: str) -> DataFrame:
    """What ``work(table, pairs)`` returns for each pair of parts: ``pairs`` are the unordered pairs of blocks, each once over
    all tasks; with ``across`` also between contexts, else inside each.  In a pair the first block has the smaller number,
    so its context does not come later."""
    components = F.sum(F.size("vecs").cast("bigint") * F.size(F.get("vecs", F.lit(0))))
    total, held = blocks.agg(F.coalesce(F.max("last") + 1, F.lit(0)), F.coalesce(components, F.lit(0))).first()
    # a pair of parts is worth a task from a few blocks on
    parts = max(1, min(PARTS, -(-total // 4)), min(total, max(-(-held // COMPONENTS), -(-total // BLOCKS_IN_PART))))
    part = lambda c: F.floor(F.col(c) * parts / max(1, total)).cast("int")
    ends = [F.lit(0), F.lit(parts - 1)] if across else [part("first"), part("last")]
    dealt = blocks.withColumn("part", part("gid")).withColumn("other", F.explode(F.sequence(*ends)))
    dealt = dealt.select(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "ctx", "gid", "keys", "vecs")

    def task(table):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        held = sorted((Block(table, at) for at in range(table.num_rows)), key=lambda b: b.gid)
        left, right = [b for b in held if b.part == i], [b for b in held if b.part == j]
        return work(table, [(a, b) for a in left for b in right if a.gid <= b.gid and (across or a.ctx == b.ctx)])

    # few groups that cost much: not put together by size
    return dealt.repartition(parts * (parts + 1), "i", "j").groupBy("i", "j").applyInArrow(task, schema)


def _kind(blocks: DataFrame, column: str = "ctx") -> str:
    return blocks.schema[column].dataType.simpleString()


def _table(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _pooled(counts: DataFrame, value: str, pairs: DataFrame) -> DataFrame:
    """From counts per (ctx_a, ctx_b) to counts per unordered context pair of pooled rows: within
    the one, within the other, and between.  ``pairs`` lists all pairs: a sweep over few bins may
    have counts for one part of a pair only."""
    cross = counts.where("ctx_a < ctx_b").select(F.col("ctx_a").alias("pa"), F.col("ctx_b").alias("pb"), "code", value, "n")
    own = counts.where("ctx_a = ctx_b").select(F.col("ctx_a").alias("c"), "code", value, "n")
    a = pairs.join(own.withColumnRenamed("c", "pa"), "pa").select("pa", "pb", "code", value, "n")
    b = pairs.join(own.withColumnRenamed("c", "pb"), "pb").select("pa", "pb", "code", value, "n")
    return cross.unionByName(a).unionByName(b)


def _distances(a: Block, b: Block):
    """The squared distances between two blocks, or inside one, each once, by tiles."""
    for i, j, d in _tiles(a.x, b.x):
        if a.gid != b.gid or i < j:
            yield d.ravel()
        elif i == j:
            yield d[np.triu_indices(len(d), 1)]


def _coarse(d: np.ndarray, top: float) -> np.ndarray:
    """Coarse bin of each distance; every pass uses this and ``_fine``, so a distance never changes its bin."""
    return np.minimum(d / (top / BINS), BINS - 1).astype(np.int64)


def _fine(d: np.ndarray, one, top: float) -> np.ndarray:
    """Fine bin of distances that lie in the coarse bin ``one``, a number or one for each."""
    w = top / BINS
    return np.clip(np.floor((d - one * w) / (w / BINS)), 0, BINS - 1).astype(np.int64)


def _count_coarse(top: float):
    def count(d, want):
        n = np.bincount(_coarse(d, top), minlength=BINS)
        code = np.flatnonzero(n)
        yield code, np.zeros(len(code)), n[code]

    return count


def _count_fine(top: float):
    def count(d, want):
        bins = _coarse(d, top)
        for one in want:
            n = np.bincount(_fine(d[bins == one], one, top), minlength=BINS)
            code = np.flatnonzero(n)
            yield one * BINS + code, np.zeros(len(code)), n[code]

    return count


def _edge(one: int, top: float) -> float:
    """The smallest distance of the coarse bin ``one`` or a later one, as ``_coarse`` rounds."""
    if one <= 0 or one >= BINS:
        return -np.inf if one <= 0 else np.inf
    w = top / BINS
    x = one * w
    while x / w >= one:
        x = np.nextafter(x, -np.inf)
    while x / w < one:
        x = np.nextafter(x, np.inf)
    return float(x)


def _count_values(top: float):
    def count(d, want):
        d = d[(d >= _edge(want[0] // BINS, top)) & (d < _edge(want[-1] // BINS + 1, top))]
        bins = _coarse(d, top)
        for one in sorted({w // BINS for w in want}):
            mine = d[bins == one]
            code = one * BINS + _fine(mine, one, top)
            for w in want:
                value, n = np.unique(mine[code == w], return_counts=True)
                yield np.full(len(value), w), value, n

    return count


def _merged(parts: list[tuple]) -> tuple:
    """(code, value, n) with equal codes and values added up."""
    code, value, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((value, code))
    code, value, n = code[order], value[order], n[order]
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (value[1:] != value[:-1])]) if len(code) else np.zeros(0, np.int64)
    return code[start], value[start], np.add.reduceat(n, start) if len(start) else n


def _counts(blocks: DataFrame, across: bool, count, want: dict | None = None) -> DataFrame:
    """ctx_a, ctx_b, code, value, n: what ``count`` gives over all block pairs; with ``want`` only for the contexts it names."""
    kind = _kind(blocks)

    def work(table, met):
        import pyarrow as pa

        held: dict = {}
        for a, b in met:
            at = (a.ctx, b.ctx)
            if want is not None and at not in want:
                continue
            parts = held.setdefault(at, [])
            for d in _distances(a, b):
                parts += count(d, want and want[at])
                if len(parts) >= 64:
                    parts[:] = [_merged(parts)]
        held = {at: _merged(parts) for at, parts in held.items() if parts}
        ctx = table.schema.field("ctx").type
        return pa.table({
            **{f"ctx_{s}": pa.array([at[i] for at, h in held.items() for _ in h[0]], ctx) for i, s in enumerate("ab")},
            **{c: pa.array(np.concatenate([np.zeros(0, t), *[h[i] for h in held.values()]]).astype(t)) for i, (c, t) in
               enumerate((("code", np.int64), ("value", np.float64), ("n", np.int64)))},
        })

    long = meet(blocks, across, work, f"ctx_a {kind}, ctx_b {kind}, code bigint, value double, n bigint")
    return long.groupBy("ctx_a", "ctx_b", "code", "value").agg(F.sum("n").alias("n"))


def _by_pair(counts: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """pa, pb, code, value, n: counts of each context pair's pooled rows, without ``pairs`` of each context.  Pooling reads the
    counts several times under other filters, so they are written first: else the sweep behind them would run again."""
    if pairs is not None:
        counts = _pooled(durable(counts), "value", pairs)
    else:
        counts = counts.where("ctx_a = ctx_b").withColumnsRenamed({"ctx_a": "pa", "ctx_b": "pb"})
    return counts.groupBy("pa", "pb", "code", "value").agg(F.sum("n").alias("n"))


def _sweep(blocks: DataFrame, across: bool, count, pairs: DataFrame | None, want: dict | None = None) -> DataFrame:
    return _by_pair(_counts(blocks, across, count, want), pairs)


def _guess(blocks: DataFrame, across: bool, top: float, pairs: DataFrame | None) -> tuple[int, int] | None:
    """First and last coarse bin between which all medians should lie, from one block of each context; only a place to look
    first.  None where there are few blocks, or where the medians lie far apart."""
    contexts, total = blocks.agg(F.count_distinct("ctx"), F.coalesce(F.max("last") + 1, F.lit(0))).first()
    if total < BLOCKS_TO_GUESS * contexts:
        return None
    seen = _counts(blocks.where("gid = first"), across, _count_coarse(top))
    n = blocks.select("ctx", F.col("n_ctx").cast("double").alias("m")).distinct()
    seen = seen.join(n.withColumnsRenamed({"ctx": "ctx_a", "m": "ma"}), "ctx_a").join(n.withColumnsRenamed({"ctx": "ctx_b", "m": "mb"}), "ctx_b")
    whole = F.col("ma") * F.col("mb") * F.when(F.col("ctx_a") == F.col("ctx_b"), 0.5).otherwise(1.0)
    seen = seen.withColumn("n", whole * F.col("n") / F.sum("n").over(Window.partitionBy("ctx_a", "ctx_b")))
    w = Window.partitionBy("pa", "pb")
    seen = _by_pair(seen, pairs).withColumns({"cum": F.sum("n").over(w.orderBy("code")), "t": F.sum("n").over(w)})
    near = seen.where("cum >= 0.45 * t AND cum - n <= 0.55 * t")
    lo, hi = near.agg(F.min("code") - 1, F.max("code") + 1).first()
    return (max(0, lo), min(BINS - 1, hi)) if lo is not None and hi - lo < GUESSED else None


def _around(blocks: DataFrame, across: bool, top: float, lo: int, hi: int) -> DataFrame:
    """ctx_a, ctx_b, code, value, n: distances in the fine bins of the coarse ones from ``lo`` to ``hi``, and all below as code -1."""
    kind = _kind(blocks)
    first, behind, size = _edge(lo, top), _edge(hi + 1, top), (hi - lo + 1) * BINS

    def work(table, met):
        import pyarrow as pa

        held, done = {}, []

        def out():
            for at, n in held.items():
                code = np.flatnonzero(n)
                done.append((at, np.where(code, code - 1 + lo * BINS, -1), n[code]))
            held.clear()

        for a, b in met:
            if (a.ctx, b.ctx) not in held:
                if len(held) == 64:
                    out()
                held[a.ctx, b.ctx] = np.zeros(size + 1, dtype=np.int64)
            n = held[a.ctx, b.ctx]
            for d in _distances(a, b):
                n[0] += np.count_nonzero(d < first)
                mine = d[(d >= first) & (d < behind)]
                one = _coarse(mine, top)
                code = (one - lo) * BINS + _fine(mine, one, top)
                n[1:] += np.bincount(code, minlength=size)
        out()
        ctx = table.schema.field("ctx").type
        return pa.table({
            **{f"ctx_{s}": pa.array([at[i] for at, c, _ in done for _ in range(len(c))], ctx) for i, s in enumerate("ab")},
            **{c: pa.array(np.concatenate([np.zeros(0, np.int64), *[x[i] for x in done]])) for i, c in ((1, "code"), (2, "n"))},
        })

    long = meet(blocks, across, work, f"ctx_a {kind}, ctx_b {kind}, code bigint, n bigint")
    return long.groupBy("ctx_a", "ctx_b", "code").agg(F.sum("n").alias("n")).withColumn("value", F.lit(0.0))


def _locate(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """The code and value holding each goal rank inside its outer bin, and the rank left in it.
    ``counts`` is a histogram per context pair, so the window is bounded by its bins."""
    w = Window.partitionBy("pa", "pb", "which").orderBy("code", "value")
    j = counts.join(goals, ["pa", "pb", "outer"]).withColumn("cum", F.sum("n").over(w))
    hit = (F.col("rank") < F.col("cum")) & (F.col("rank") >= F.col("cum") - F.col("n"))
    return durable(j.where(hit).select("pa", "pb", "which", "code", "value", (F.col("rank") - (F.col("cum") - F.col("n"))).alias("rank")))


def _wanted(at: DataFrame, pooled: bool) -> dict:
    """The codes that each context pair is looking for, by the context pairs that serve it: two rows for each."""
    out: dict = {}
    for x in at.select("pa", "pb", "code").collect():
        for ends in {(x.pa, x.pa), (x.pb, x.pb), (x.pa, x.pb)} if pooled else {(x.pa, x.pb)}:
            out.setdefault(ends, set()).add(x.code)
    return {k: sorted(v) for k, v in out.items()}


def _goals(total: DataFrame) -> DataFrame:
    """The ranks, from 0, of the one or two middle ones among ``t`` distances."""
    return total.select("pa", "pb", F.lit(0).alias("outer"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.floor((F.col("t") - 1) / 2).alias("rank")),
        F.struct(F.lit(1).alias("which"), F.floor(F.col("t") / 2).alias("rank")))).alias("g")).select("pa", "pb", "outer", "g.*")


def _middle_around(blocks: DataFrame, pooled: bool, top: float, pairs: DataFrame | None, lo: int, hi: int) -> DataFrame | None:
    """The fine bins of all middle ranks as ``_locate`` gives them, or None if one does not lie in coarse bins ``lo`` to ``hi``."""
    n = blocks.select("ctx", "n_ctx").distinct()
    if pooled:
        ends = (n.withColumnsRenamed({"ctx": p, "n_ctx": c}) for p, c in (("pa", "_na"), ("pb", "_nb")))
        sizes = pairs.join(next(ends), "pa").join(next(ends), "pb").select("pa", "pb", (F.col("_na") + F.col("_nb")).alias("m"))
    else:
        sizes = n.select(F.col("ctx").alias("pa"), F.col("ctx").alias("pb"), F.col("n_ctx").alias("m"))
    goals = _goals(sizes.select("pa", "pb", F.expr("m * (m - 1) div 2").alias("t")).where("t > 0"))
    counts = durable(_by_pair(_around(blocks, pooled, top, lo, hi), pairs))
    at = _locate(counts.withColumn("outer", F.lit(0)), goals)
    return at if at.where("code >= 0").count() == goals.count() else None


def median_sq_distance(blocks: DataFrame, pooled: bool) -> DataFrame:
    """Exact median squared distance per context pair (pooled rows of both), or per context when
    ``pooled`` is false: columns pa, pb, med.

    A first sweep counts distances in coarse bins, a second in fine bins of the coarse ones that
    hold the middle, the third takes the distinct values of the final bins with their counts.  The
    few rows that steer the next sweep are written between sweeps.  With many blocks one sweep does for the first two: it counts
    what lies below the coarse bins in which a few blocks have their middle, and cuts those finely.  If the counts say
    that some middle is not there, the two sweeps follow."""
    most = blocks.select(F.explode("vecs").alias("v")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()[0]
    top = 4.0 * (most or 0.0) + 1e-12
    pairs = durable(context_pairs(blocks, "ctx").withColumnsRenamed({"ctx_a": "pa", "ctx_b": "pb"})) if pooled else None
    at2 = None
    if (span := _guess(blocks, pooled, top, pairs)) is not None:
        at2 = _middle_around(blocks, pooled, top, pairs, *span)
    if at2 is None:
        one = durable(_sweep(blocks, pooled, _count_coarse(top), pairs))
        at = _locate(one.withColumn("outer", F.lit(0)), _goals(one.groupBy("pa", "pb").agg(F.sum("n").alias("t"))))
        two = _sweep(blocks, pooled, _count_fine(top), pairs, _wanted(at, pooled))
        at = at.select("pa", "pb", "which", "rank", F.col("code").alias("outer"))
        two = durable(two.withColumn("outer", F.floor(F.col("code") / BINS)))
        at2 = _locate(two, at)
    three = _sweep(blocks, pooled, _count_values(top), pairs, _wanted(at2, pooled)).withColumn("outer", F.col("code"))
    at3 = _locate(three, at2.select("pa", "pb", "which", "rank", F.col("code").alias("outer")))
    return at3.groupBy("pa", "pb").agg(F.greatest(F.avg("value"), F.lit(1e-12)).alias("med"))


def mmd2_pairs(df: DataFrame, context: str, key: str, vec: str, bandwidth: str = "per_pair", size: int = BLOCK) -> DataFrame:
    """ctx_a, ctx_b, bandwidth_sq, mmd2 for every unordered pair of contexts: biased squared MMD with a
    Gaussian kernel whose bandwidth is the median squared distance of the pair's pooled rows, or one
    median over all rows with ``bandwidth="pooled"``."""
    blocks = pack(df, context, key, vec, size)
    if bandwidth == "per_pair":
        bw = durable(median_sq_distance(blocks, pooled=True))
    elif bandwidth == "pooled":
        whole = pack(df.withColumn("_all", F.lit("all")), "_all", key, vec, size)
        one = median_sq_distance(whole, pooled=False).select("med").scalar()
        bw = durable(context_pairs(df, context).select(F.col("ctx_a").alias("pa"), F.col("ctx_b").alias("pb"), one.alias("med")))
    else:
        raise ValueError(f"unknown bandwidth rule {bandwidth}")
    uses: dict = {}
    for u in bw.where("med IS NOT NULL").collect():  # one row per context pair
        for ends in ((u.pa, u.pa), (u.pb, u.pb), (u.pa, u.pb)):
            uses.setdefault(ends, []).append((u.pa, u.pb, u.med))
    kind = _kind(blocks)

    def sums(table, met):
        import pyarrow as pa

        held: dict = {}
        for a, b in met:
            mine = uses.get((a.ctx, b.ctx), [])
            if not mine:
                continue
            # two different blocks of one context stand for both orders of their rows
            times = 2.0 if a.ctx == b.ctx and a.gid != b.gid else 1.0
            each = sorted({m for _, _, m in mine})
            tile = np.zeros(len(each))
            for _, _, d in _tiles(a.x, b.x):
                for at, m in enumerate(each):
                    k = d / (-2.0 * m)
                    tile[at] += np.exp(k, out=k).sum()
            for m, s in zip(each, times * tile):
                for p, q, med in mine:
                    if med == m:
                        into = held.setdefault((p, q), [0.0, 0.0, 0.0])
                        into[2 if a.ctx != b.ctx else 0 if a.ctx == p else 1] += s
        ctx = table.schema.field("ctx").type
        return _table([(*k, *v) for k, v in held.items()], pa.schema(
            [("pa", ctx), ("pb", ctx), ("kxx", pa.float64()), ("kyy", pa.float64()), ("kxy", pa.float64())]))

    parts = meet(blocks, True, sums, f"pa {kind}, pb {kind}, kxx double, kyy double, kxy double")
    n = blocks.select("ctx", "n_ctx").distinct()
    tot = parts.groupBy("pa", "pb").agg(*[F.sum(c).alias(c) for c in ("kxx", "kyy", "kxy")]).join(bw, ["pa", "pb"])
    tot = tot.join(n.select(F.col("ctx").alias("pa"), F.col("n_ctx").alias("na")), "pa").join(
        n.select(F.col("ctx").alias("pb"), F.col("n_ctx").alias("nb")), "pb")
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    return tot.select(
        F.col("pa").alias("ctx_a"), F.col("pb").alias("ctx_b"), F.col("med").alias("bandwidth_sq"),
        (F.col("kxx") / (na * na) + F.col("kyy") / (nb * nb) - 2 * F.col("kxy") / (na * nb)).alias("mmd2"),
    )


def mean_mmd2(df, context, key, vec, bandwidth="per_pair", size=BLOCK) -> DataFrame:
    """Mean over context pairs; zero when there are fewer than two contexts."""
    return mmd2_pairs(df, context, key, vec, bandwidth, size).agg(
        F.coalesce(F.avg("mmd2"), F.lit(0.0)).alias("mean_mmd2"), F.count(F.lit(1)).alias("n_pairs")
    )


def rbf_cka(df: DataFrame, context: str, key: str, x: str, y: str, size: int = BLOCK) -> DataFrame:
    """RBF similarity of two representations of the same rows, per context, with a median bandwidth for
    each.  Centred Gram products follow from the plain sums and the row sums, so no Gram matrix is
    kept."""
    both = df.select(context, key, F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("_xy"), x, y)
    bx, by = ({u.pa: u.med for u in median_sq_distance(pack(both, context, key, c, size), False).collect()} for c in (x, y))
    dims = both.agg(F.max(F.size(x))).first()[0]
    blocks = pack(both, context, key, "_xy", size)
    kind = _kind(blocks)

    def grams(table, met):
        import pyarrow as pa

        held: dict = {}
        for a, b in met:
            if a.ctx not in bx or a.ctx not in by:
                continue
            k, l = (np.exp(-_d2(a.x[:, c], b.x[:, c]) / (2.0 * m)) for c, m in ((slice(None, dims), bx[a.ctx]), (slice(dims, None), by[a.ctx])))
            into = [held.setdefault(z.gid, [z.ctx, z.gid, np.zeros(len(z.x)), np.zeros(len(z.x)), 0.0, 0.0, 0.0]) for z in (a, b)]
            into[0][2] += k.sum(1)
            into[0][3] += l.sum(1)
            if a.gid != b.gid:
                # a block pair off the diagonal serves the rows of both its blocks
                into[1][2] += k.sum(0)
                into[1][3] += l.sum(0)
            twice = 1.0 if a.gid == b.gid else 2.0
            for at, (p, q) in enumerate(((k, l), (k, k), (l, l))):
                into[0][4 + at] += twice * float(np.vdot(p, q))
        many = pa.list_(pa.float64())
        return _table(list(held.values()), pa.schema([("ctx_a", table.schema.field("ctx").type), ("gid", pa.int64()), ("r", many), ("t", many)] + [(c, pa.float64()) for c in ("kl", "kk", "ll")]))

    g = durable(meet(blocks, False, grams, f"ctx_a {kind}, gid bigint, r array<double>, t array<double>, kl double, kk double, ll double"))
    rows = g.select("ctx_a", "gid", F.posexplode(F.arrays_zip(F.col("r").alias("ks"), F.col("t").alias("ls"))).alias("k", "z"))
    rows = rows.groupBy("ctx_a", "gid", "k").agg(F.sum("z.ks").alias("r"), F.sum("z.ls").alias("t"))
    rs = rows.groupBy("ctx_a").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("r").alias("sk"), F.sum("t").alias("sl"),
        F.sum(F.col("r") * F.col("t")).alias("rkl"), F.sum(F.col("r") * F.col("r")).alias("rkk"), F.sum(F.col("t") * F.col("t")).alias("rll"),
    )
    fs = g.groupBy("ctx_a").agg(*[F.sum(c).alias(c) for c in ("kl", "kk", "ll")])
    j = fs.join(rs, "ctx_a")

    def hsic(full, row, s, t):
        n = F.col("n")
        return F.col(full) - 2 * F.col(row) / n + F.col(s) * F.col(t) / (n * n)

    kl, kk, ll = hsic("kl", "rkl", "sk", "sl"), hsic("kk", "rkk", "sk", "sk"), hsic("ll", "rll", "sl", "sl")
    return j.select(
        F.col("ctx_a").alias(context),
        F.try_divide(kl, F.sqrt(F.greatest(kk, F.lit(0.0)) * F.greatest(ll, F.lit(0.0)))).alias("rbf_cka"),
    )


#: Coordinate differences held at once in a task.
DIFFERENCES = 4_000_000


def _nearest(x: np.ndarray, y: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple:
    """row, column, d2: for each row of x at least its k nearest rows of y; those farther than ``known`` may miss.

    A matrix product leaves those out that are farther than the k-th of a tile, or than ``known``, by more than its rounding
    could make them; the differences of the others are summed."""
    # a bound of the rounding of every product and sum, on either side
    slack = 8.0 * (x.shape[1] + 8) * np.finfo(float).eps * ((x * x).sum(1) + (y * y).sum(1).max(initial=0.0))
    most = np.full(len(x), np.inf) if known is None else known + slack
    found = []
    for i, j, d in _tiles(x, y):
        mine = most[i : i + len(d)]
        if d.shape[1] > k and not np.isfinite(mine).all():
            np.fmin(mine, np.partition(d, k - 1, axis=1)[:, k - 1] + slack[i : i + len(d)], out=mine)
        row, col = np.nonzero(~(d > mine[:, None]))
        found.append((row + i, col + j))
    row, col = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*found) if found else ((), ())))
    step = max(1, DIFFERENCES // max(1, x.shape[1]))
    d2 = [((x[row[i : i + step]] - y[col[i : i + step]]) ** 2).sum(1) for i in range(0, len(row), step)]
    return row, col, np.concatenate([np.zeros(0), *d2])


def _best(row, key, d2, k: int) -> tuple:
    """The k smallest (d2, key) of each row."""
    order = np.lexsort((key, d2, row))
    row, key, d2 = row[order], key[order], d2[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return row[place < k], key[place < k], d2[place < k]


def _farthest(best: tuple, rows: int, k: int) -> np.ndarray:
    """The k-th smallest distance of each row by what ``_best`` gave; infinite for a row with fewer."""
    row, _, d2 = best
    out = np.full(rows, np.inf)
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, np.int64)
    full = last[np.bincount(row, minlength=rows)[row[last]] >= k]
    out[row[full]] = d2[full]
    return out


def nearest(df: DataFrame, context: str, key: str, vec: str, k: int = 1, done: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """ctx_a, ctx_b, row_a, row_b, d2: for every row of the first context its k nearest rows of the
    second by squared distance, ties to the smaller key.  Exact for any width: a task returns
    the k best of each row among its blocks, and the best of all are kept.  ``done`` lists context pairs to
    leave out.  For a scalar coordinate :func:`screenloom.operators.pairs.tier3` needs no distances."""
    blocks = pack(df, context, key, vec, size)
    skip = {(r.ctx_a, r.ctx_b) for r in done.select("ctx_a", "ctx_b").distinct().collect()} if done is not None else set()
    ctx, name = _kind(blocks), df.schema[key].dataType.simpleString()

    def best(table, met):
        import pyarrow as pa

        keys, held = {}, {}
        for a, b in met:
            if a.ctx == b.ctx or (a.ctx, b.ctx) in skip:
                continue
            for z in (a, b):
                if z.gid not in keys:
                    keys[z.gid] = z.keys(table)
            old = held.get((a.gid, b.ctx))
            row, col, d2 = _nearest(a.x, b.x, k, None if old is None else _farthest(old[1], len(a.x), k))
            new = row, keys[b.gid][col], d2
            held[a.gid, b.ctx] = a.ctx, _best(*(new if old is None else [np.concatenate(z) for z in zip(old[1], new)]), k)
        kinds = table.schema.field("ctx").type, table.schema.field("keys").type.value_type
        flat = [np.concatenate(z).tolist() if z else [] for z in (
            [keys[g][h[1][0]] for (g, _), h in held.items()], [h[1][1] for h in held.values()], [h[1][2] for h in held.values()])]
        sizes = [(h[0], c, len(h[1][0])) for (_, c), h in held.items()]
        return pa.table({
            "ctx_a": pa.array([c for c, _, n in sizes for _ in range(n)], kinds[0]), "ctx_b": pa.array([c for _, c, n in sizes for _ in range(n)], kinds[0]),
            "row_a": pa.array(flat[0], kinds[1]), "row_b": pa.array(flat[1], kinds[1]), "d2": pa.array(flat[2], pa.float64()),
        })

    cand = meet(blocks, True, best, f"ctx_a {ctx}, ctx_b {ctx}, row_a {name}, row_b {name}, d2 double")
    w = Window.partitionBy("ctx_a", "ctx_b", "row_a").orderBy("d2", "row_b")
    return cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def soft_ranks(df: DataFrame, group: str, key: str, cols: list[str], tau: float = 0.1, size: int = BLOCK) -> DataFrame:
    """group, key and for each column its soft rank: the sum over other rows of the logistic of the
    scaled difference."""
    blocks = pack(df.select(group, key, F.array(*[F.col(c).cast("double") for c in cols]).alias("_v")), group, key, "_v", size)

    def part(table, met):
        import pyarrow as pa

        held: dict = {}
        for a, b in met:
            left, right = (held.setdefault(z.gid, (z, np.zeros_like(z.x)))[1] for z in (a, b))
            for c in range(a.x.shape[1]):
                s = (b.x[:, c][None, :] - a.x[:, c][:, None]) / max(tau, 1e-12)
                np.exp(np.clip(s, -700, 700, out=s), out=s)
                s += 1.0
                np.reciprocal(s, out=s)
                if a.gid == b.gid:
                    np.fill_diagonal(s, 0.0)
                left[:, c] += s.sum(1)
                if a.gid != b.gid:
                    right[:, c] += len(a.x) - s.sum(0)
        at = pa.array([z.at for z, _ in held.values()], pa.int64())
        return pa.table({"ctx": table["ctx"].take(at), "keys": table["keys"].take(at),
                         "s": pa.array([x.tolist() for _, x in held.values()], pa.list_(pa.list_(pa.float64())))})

    g = meet(blocks, False, part, f"ctx {_kind(blocks)}, keys {_kind(blocks, 'keys')}, s array<array<double>>")
    rows = g.select("ctx", F.explode(F.arrays_zip(F.col("keys").alias("k"), "s")).alias("z"))
    return rows.groupBy(F.col("ctx").alias(group), F.col("z.k").alias(key)).agg(
        *[F.sum(F.col("z.s")[i]).alias(f"soft_{c}") for i, c in enumerate(cols)])
