"""Bootstrap intervals, matched subsamples, folds and batches by keyed draws."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from screenloom.functions import draws
from screenloom.functions.hashing import order_key
from screenloom.functions.ordered import GROUP_LIMIT, ordinal, running
from screenloom.functions.sizes import broadcast_if_small
from screenloom.session import durable


#: Beyond so many rows, a task that resamples rank correlations holds two strips of them, not all.
ROWS_IN_TASK = 2_000_000
#: Rows of a strip.
PART_ROWS = 5_000_000
#: Replicates that go through a strip together, and rows of it that they go through at once, so that these stay in a core's cache.
ABREAST, PIECE = 8, 1 << 14
#: Bytes of rows that further tasks for the same strips may have moved for them.
MOVED = 8 << 30
#: Replicates whose moments are summed together, and rows of which they are summed at once: the rows are read once for all.
TOGETHER, ROWS_AT_ONCE = 16, 8192


def summarize(deltas: DataFrame, value="delta", keys: list[str] = []) -> DataFrame:
    """Median, 95 % percentile interval, sign stability, and the count of undefined replicates."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q")
    pos = F.try_divide(F.count_if(F.col(value) > 0).cast("double"), F.count(value))
    aggs = [q, pos.alias("pos"), F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_skipped")]
    out = deltas.groupBy(*keys).agg(*aggs) if keys else deltas.agg(*aggs)
    return out.select(
        *keys, F.col("q")[0].alias("median"), F.col("q")[1].alias("ci_lo"), F.col("q")[2].alias("ci_hi"),
        F.greatest("pos", 1 - F.col("pos")).alias("sign_stab"), "n", "n_skipped",
    )


def _slabs(spark, groups: int, reps: int) -> int:
    """Into how many runs of replicates a group's work is cut while there are cores for it; two for each core."""
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(reps, -(-2 * cores // max(groups, 1))))


def _apart(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Groups are few and small but cost much, so they are not put together by size."""
    return df.repartition(4 * groups, *keys)


def _run(slab: int, slabs: int, reps: int) -> range:
    return range(slab * reps // slabs + 1, (slab + 1) * reps // slabs + 1)


def _weighted(moments: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """replicates x moments: sums weighted by each replicate's multiplicities; equal moments are summed once."""
    first = [next(j for j in range(i + 1) if np.array_equal(moments[j], moments[i])) for i in range(len(moments))]
    kept = sorted(set(first))
    once, out = moments[kept], np.zeros((len(weights), len(kept)))
    for at in range(0, moments.shape[1], ROWS_AT_ONCE):
        out += weights[:, at : at + ROWS_AT_ONCE].astype(np.float64) @ once[:, at : at + ROWS_AT_ONCE].T
    return out[:, [kept.index(i) for i in first]]


def _block_sums(n: int, reps: int, slabs: int, seed: int, size: int, names: list[str]):
    """Grouped Arrow task over one block of rows: for each replicate of the run the moments, weighted by multiplicities."""

    def run(table):
        import pyarrow as pa

        block, slab = table["block"][0].as_py(), table["slab"][0].as_py()
        table = table.sort_by("at")
        moments = np.stack([table[c].to_numpy() for c in names])
        known = draws.numbers(0, min(moments.shape[1], draws.AT_ONCE))
        wanted = _run(slab, slabs, reps)
        sums = np.zeros((len(wanted), len(names)))
        for at in range(0, len(wanted), TOGETHER):
            drawn = np.array([draws.multiplicities(seed, rep, n, block, size, known).astype(np.int32) for rep in wanted[at : at + TOGETHER]])
            sums[at : at + TOGETHER] = _weighted(moments, drawn)
        return pa.table({"rep": pa.array(list(wanted), pa.int32())} | {c: pa.array(sums[:, i]) for i, c in enumerate(names)})

    return run


def row_bootstrap_delta_r2(
    df: DataFrame, key: str, y: str, arm_a: list[str], arm_b: list[str], reps=10000, seed=42, limit=GROUP_LIMIT, block: int | None = None
) -> DataFrame:
    """rep, delta: mean R2 of arm a minus mean R2 of arm b over one shared resample of rows.

    Rows are numbered in the order of ``key`` and lie in blocks.  A task makes the multiplicities of its own block for all
    replicates and multiplies them with the rows' moments, so that only replicates x moments move; see
    :mod:`screenloom.functions.draws`.  While there are fewer blocks than cores, runs of replicates share a block."""
    size = block or draws.BLOCK
    n = df.count()
    preds = sorted({*arm_a, *arm_b})
    rows = ordinal(df.select(key, y, *preds), [], [key], "_i", None if limit is None or n <= limit else 0)
    centre = df.agg(F.avg(y)).scalar()
    rows = rows.withColumn("_y", F.col(y) - centre)
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    moments = {"n": one(F.col("_y").isNotNull()), "s": one(F.col("_y")), "q": one(F.col("_y") * F.col("_y"))}
    for i, p in enumerate(preds):
        d = F.col(y) - F.col(p)
        moments |= {f"e{i}": one(d * d), f"k{i}": one((d * d).isNotNull())}
    slabs = _slabs(df.sparkSession, -(-n // size), reps)
    placed = rows.select(
        F.floor(F.col("_i") / size).cast("int").alias("block"), (F.col("_i") % size).alias("at"), *[c.alias(m) for m, c in moments.items()],
        F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"),
    )
    names = list(moments)
    schema = "rep int, " + ", ".join(f"{m} double" for m in names)
    placed = _apart(placed, slabs * max(1, -(-n // size)), "block", "slab")
    sums = placed.groupBy("block", "slab").applyInArrow(_block_sums(n, reps, slabs, seed, size, names), schema)
    sums = sums.groupBy("rep").agg(*[F.sum(m).alias(m) for m in names])
    spread = F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("n"))
    # a resample with one distinct value leaves rounding only
    spread = F.when(spread > F.col("q") * 1e-13, spread)
    r2 = {p: F.when(F.col(f"k{i}") > 0, F.lit(1.0) - F.col(f"e{i}") / spread) for i, p in enumerate(preds)}
    mean = lambda arm: sum((r2[p] for p in arm[1:]), r2[arm[0]]) / len(arm)
    return sums.select("rep", (mean(arm_a) - mean(arm_b)).alias("delta"))


def _rank_codes(column) -> np.ndarray:
    """Dense ranks from 0; null comes first, NaN last."""
    null = np.asarray(column.is_null())
    values = column.cast("double").fill_null(0.0).to_numpy()
    codes = np.zeros(len(values), dtype=np.int64)
    codes[~null] = np.unique(values[~null], return_inverse=True)[1] + null.any()
    return codes


def _rhos(n_clusters: int, reps: int, slabs: int, seed: int, y: str, cols: list[str]):
    """Grouped Arrow task over all rows and a run of replicates: weighted average-tie ranks and their correlations.

    Every column is put in order once; a replicate's ranks are prefix sums of its weights along that order, ties kept
    together."""

    def run(table):
        import pyarrow as pa

        slab = table["slab"][0].as_py()
        cluster = table["c"].to_numpy()
        codes = {c: _rank_codes(table[c]) for c in (y, *cols)}
        known = draws.numbers(0, min(n_clusters, draws.AT_ONCE))
        out: dict[str, list] = {c: [] for c in cols}
        wanted = _run(slab, slabs, reps)
        for rep in wanted:
            w = draws.multiplicities(seed, rep, n_clusters, known=known)[cluster]
            total = w.sum()
            dev = {}
            for c, code in codes.items():
                tied = np.bincount(code, weights=w)
                # all ranks add up to a known number, so their mean is taken off at once
                dev[c] = (np.cumsum(tied) - tied + (tied + 1) / 2 - (total + 1) / 2)[code]
            wy = w * dev[y]
            vy = float(wy @ dev[y])
            for c in cols:
                vc = float((w * dev[c]) @ dev[c])
                out[c].append(float(wy @ dev[c]) / np.sqrt(vy * vc) if vy > 0 and vc > 0 else None)
        return pa.table({"rep": pa.array(list(wanted), pa.int32())} | {f"rho_{i}": pa.array(out[c], pa.float64()) for i, c in enumerate(cols)})

    return run


def _counts(rows: np.ndarray):
    """Numbers of equal rows; None where every row is one of its kind."""
    return None if (rows == 1).all() else rows


class _Line:
    """Rows of one strip along a column, those of a cluster in a tie as one entry; an entry's draws are its cluster's."""

    def __init__(self, place, cluster, rows, n_clusters: int):
        key = (place - place.min(initial=np.iinfo(place.dtype).max)).astype(np.int64) * n_clusters + cluster
        key, at = np.unique(key, return_inverse=True)
        self.at = at.astype(place.dtype)
        del at
        tie, cluster = np.divmod(key, n_clusters)
        self.cluster = cluster.astype(np.int32 if n_clusters < 1 << 31 else np.int64)
        self.rows = _counts(np.bincount(self.at, weights=rows, minlength=len(key)).astype(np.int64))
        new = np.r_[True, tie[1:] != tie[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.ties, self.tied = len(first), len(first) < len(key)
        # an entry without ties is its own
        self.tie, self.last = ((np.cumsum(new) - 1).astype(np.int32), np.r_[first[1:], len(key)] - 1) if self.tied else (None, None)
        # pieces of entries that stay in a cache; no tie lies in two
        ties = np.unique(np.searchsorted(first, np.arange(0, len(key), PIECE)))
        ties = ties[ties < len(first)]
        self.cuts = [*zip(first[ties], np.r_[first[ties[1:]], len(key)], ties, np.r_[ties[1:], len(first)])] if len(key) else []

    def pieces(self, drawn: np.ndarray, kind, cubes: np.ndarray | None):
        """For each piece: its first and last entry and tie, the entries' draws, twice the ties' ranks less one, the weight upto.

        ``cubes`` gets the cubes of the ties' weights added."""
        before = np.zeros(drawn.shape[1], kind)
        if cubes is not None and not self.tied:
            each = np.bincount(self.cluster, weights=None if self.rows is None else self.rows.astype(np.float64) ** 3, minlength=len(drawn))
            drawn64 = drawn.astype(np.float64)
            cubes += _column_sums(drawn64 * drawn64 * drawn64, each.astype(np.float64))
        for a, b, first, last in self.cuts:
            w = drawn.take(self.cluster[a:b], axis=0)
            upto = w.astype(kind) if self.rows is None else (w * self.rows[a:b, None]).astype(kind)
            upto[0] += before
            np.cumsum(upto, axis=0, out=upto)
            if self.tied:
                upto = upto.take(self.last[first:last] - a, axis=0)
                if cubes is not None:
                    tied = np.diff(upto, axis=0, prepend=before[None]).astype(np.float64)
                    cubes += _column_sums(tied * tied * tied)
            twice = upto.copy()
            twice[0] += before
            twice[1:] += upto[:-1]
            before = upto[-1]
            yield a, b, first, last, w, twice, before

    def of_entries(self, twice, a: int, b: int, first: int):
        return twice.take(self.tie[a:b] - first, axis=0) if self.tied else twice


def _column_sums(x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    return (np.ones(len(x)) if rows is None else rows) @ x


def _strips(n_clusters: int, reps: int, slabs: int, seed: int, strip: int, number: str):
    """Grouped Arrow task over a strip i of y and a strip j of a column: for each replicate of the run the weight of the rows
    in both and their moments of ranks inside the strips; by the first pair of a strip also its weight and the cubes of its ties' weights.

    Replicates go ``ABREAST``, so that a row's place is looked up once for all of them; only y's ranks are held."""

    def run(table):
        import pyarrow as pa

        col, i, j, slab = (table[c][0].as_py() for c in ("col", "i", "j", "slab"))
        packed = [np.frombuffer(x.as_buffer(), number).reshape(4, -1) for x in table["rows"]]
        cluster, y, x, rows = np.concatenate(packed, axis=1)
        del packed, table
        in_y, in_x = y // strip == i, x // strip == j
        ly, lx = (_Line(z[at], cluster[at], rows[at], n_clusters) for z, at in ((y, in_y), (x, in_x)))
        both = in_y & in_x
        ey, ex, many = ly.at[both[in_y]], lx.at[both[in_x]], rows[both]
        # rows in both strips that belong to a cluster, and to an entry
        of_c = np.bincount(cluster[both], weights=many, minlength=n_clusters)
        of_y, of_x = (np.bincount(e, weights=many, minlength=len(z.cluster)) for e, z in ((ey, ly), (ex, lx)))
        starts = np.array([a for a, *_ in lx.cuts], dtype=np.int64)
        piece = np.searchsorted(starts, ex, "right") - 1
        tie_y = ly.tie[ey] if ly.tied else ey
        order = np.argsort(piece * np.int64(max(ly.ties, 1)) + tie_y)
        ends = np.searchsorted(piece[order], np.arange(len(starts) + 1))
        in_piece = (ex - starts[piece])[order].astype(np.int32) if len(starts) else ex
        tie_y = tie_y[order]
        many = _counts(many[order].astype(np.float64))
        del cluster, y, x, rows, in_y, in_x, both, ey, ex, piece, order, ly.at, lx.at
        most = max((int(z.cluster.size if z.rows is None else z.rows.sum()) for z in (ly, lx)), default=0)
        known = draws.numbers(0, min(n_clusters, draws.AT_ONCE))
        wanted = _run(slab, slabs, reps)
        out = []
        held = None
        for at in range(0, len(wanted), ABREAST):
            some = wanted[at : at + ABREAST]
            drawn = _abreast([draws.multiplicities(seed, rep, n_clusters, known=known) for rep in some])
            kind = np.int32 if 3 * most * int(drawn.max(initial=0)) < 1 << 31 else np.int64
            if held is None or held.shape[1] != len(some) or held.dtype != kind:
                held = np.empty((ly.ties, len(some)), kind)
            w = _column_sums(drawn.astype(np.float64), of_c)
            a, b, ab, cy, cx = np.zeros((5, len(some)))
            wy, wx = np.zeros((2, len(some)), np.int64)
            for lo, hi, first, last, d, twice, wy in ly.pieces(drawn, kind, cy if j == 0 else None):
                held[first:last] = twice
                a += _column_sums(d * ly.of_entries(twice, lo, hi, first).astype(np.float64), of_y[lo:hi])
            for k, (lo, hi, first, last, d, twice, wx) in enumerate(lx.pieces(drawn, kind, cx if i == 0 else None)):
                ranked = d * lx.of_entries(twice, lo, hi, first).astype(np.float64)
                b += _column_sums(ranked, of_x[lo:hi])
                for p in range(ends[k], ends[k + 1], PIECE):
                    q = min(p + PIECE, ends[k + 1])
                    met = ranked.take(in_piece[p:q], axis=0)
                    met *= held.take(tie_y[p:q], axis=0)
                    ab += _column_sums(met, None if many is None else many[p:q])
            # ranks are half of what was summed, and a half
            a, b, ab = (a + w) / 2, (b + w) / 2, (ab + a + b + w) / 4
            zero = np.zeros(len(some))
            for kindof, y_strip, x_strip, sums in ((0, i, j, (w, a, b, ab)), (1, i, 0, (wy, cy, zero, zero)), (2, 0, j, (wx, cx, zero, zero))):
                if kindof == 0 or (j == 0 if kindof == 1 else i == 0):
                    out += [(rep, kindof, y_strip, x_strip, *map(float, z)) for rep, *z in zip(some, *sums)]
        names = ("rep", "kind", "i", "j", "w", "a", "b", "ab")
        kinds = [pa.int32()] * 4 + [pa.float64()] * 4
        cols = {c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(names, kinds))}
        return pa.table({"col": pa.array(np.full(len(out), col, np.int32))} | cols)

    return run


def _abreast(drawn: list[np.ndarray]) -> np.ndarray:
    """clusters x replicates, in the smallest type: a small table is read faster."""
    out = np.empty((len(drawn[0]), len(drawn)), np.min_scalar_type(max(int(d.max(initial=0)) for d in drawn)))
    for k, d in enumerate(drawn):
        out[:, k] = d
    return out


def _packed(strip: int, strips: int, number: str):
    """Arrow batches of col, c, y, x and m, packed for each pair of strips whose task needs them: by strip of y and by strip of the column."""

    def run(batches):
        import pyarrow as pa

        every = np.arange(strips)
        for batch in batches:
            rows = np.stack([batch[c].to_numpy().astype(number) for c in ("c", "y", "x", "m")])
            i, j = rows[1] // strip, rows[2] // strip
            at, s = (z.ravel() for z in np.meshgrid(np.arange(rows.shape[1]), every, indexing="ij"))
            other = s != i[at]
            first = batch["col"].to_numpy().astype(np.int64) * strips * strips
            cell = np.r_[first[at] + i[at] * strips + s, (first[at] + s * strips + j[at])[other]]
            at = np.r_[at, at[other]]
            order = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[order], return_index=True)
            data = [rows[:, x].tobytes() for x in np.split(at[order], starts[1:])] if len(cells) else []
            col, i, j = cells // (strips * strips), cells // strips % strips, cells % strips
            arrays = [pa.array(z.astype(np.int32)) for z in (col, i, j)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(data, pa.binary())], ["col", "i", "j", "rows"])

    return run


def _places(rows: DataFrame, of: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the number of rows ``of`` the table below the value, which ties share; null comes first, NaN last."""
    ties = running(of.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_t")), [], ["_v"], ["_t"], 0)
    return rows.join(ties.select("_v", F.col("_t_before").alias(name)), F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def _rhos_by_strips(rows: DataFrame, y: str, cols: list[str], n: int, n_clusters: int, reps: int, seed: int) -> DataFrame:
    """rep, rho_0, ...: the correlations of :func:`_rhos` for rows of any number, given as c, y and the columns.

    Along y and along each column rows are cut into strips.  A rank is the weight of the earlier strips and the rank inside the
    strip; a task makes the latter for one strip of y and one of the column, and sums of products for the rows in both.  Only
    replicates x pairs of strips come out.  Rows that no column tells apart travel as one with their number; they are packed, and
    runs of replicates share a pair of strips only while ``MOVED`` bytes of copies do."""
    rows = durable(rows)
    placed = _places(rows, rows, y, "p_y")
    for k, c in enumerate(cols):
        placed = _places(placed, rows, c, f"p_{k}")
    strips = -(-n // PART_ROWS)
    number = "<i4" if max(n, n_clusters) < 1 << 31 else "<i8"
    pairs, per_row = strips * strips * len(cols), 4 * int(number[-1]) * (2 * strips - 1) * len(cols)
    slabs = min(_slabs(rows.sparkSession, pairs, reps), max(1, MOVED // max(n * per_row, 1)))
    long = placed.select("c", F.col("p_y").alias("y"), F.posexplode(F.array(*[f"p_{k}" for k in range(len(cols))])).alias("col", "x"))
    long = long.groupBy("col", "c", "y", "x").agg(F.count(F.lit(1)).alias("m"))
    tasks = long.mapInArrow(_packed(PART_ROWS, strips, number), "col int, i int, j int, rows binary")
    tasks = tasks.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    tasks = tasks.withColumn("task", ((F.col("col") * strips + F.col("i")) * strips + F.col("j")) * slabs + F.col("slab"))
    tasks = tasks.repartitionById(pairs * slabs, "task").groupBy("task")
    schema = "col int, rep int, kind int, i int, j int, w double, a double, b double, ab double"
    sums = durable(tasks.applyInArrow(_strips(n_clusters, reps, slabs, seed, PART_ROWS, number), schema))

    def line(kind: int, at: str, name: str) -> DataFrame:
        of = Window.partitionBy("col", "rep")
        before = F.coalesce(F.sum("w").over(of.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        # earlier strips' weight less the mean of all ranks
        return sums.where(F.col("kind") == kind).select("col", "rep", at, "w", "a", (before - (F.sum("w").over(of) + 1) / 2).alias(name))

    ly, lx = line(1, "i", "oy"), line(2, "j", "ox")
    # all ranks' spread is known but for ties
    all_ = F.sum("w")
    spread = lambda z, o: z.groupBy("col", "rep").agg(((all_ * all_ * all_ - F.sum("a")) / 12).alias(f"v{o}"))
    both = sums.where("kind = 0").join(ly.select("col", "rep", "i", "oy"), ["col", "rep", "i"]).join(lx.select("col", "rep", "j", "ox"), ["col", "rep", "j"])
    cov = both.groupBy("col", "rep").agg(F.sum(F.expr("oy * ox * w + ox * a + oy * b + ab")).alias("cov"))
    rho = cov.join(spread(ly, "oy"), ["col", "rep"]).join(spread(lx, "ox"), ["col", "rep"])
    rho = rho.withColumn("rho", F.expr("CASE WHEN voy > 0.01 AND vox > 0.01 THEN cov / sqrt(voy * vox) END"))
    return rho.groupBy("rep").agg(*[F.max(F.when(F.col("col") == k, F.col("rho"))).alias(f"rho_{k}") for k in range(len(cols))])


def cluster_bootstrap_rho(
    df: DataFrame, cluster: str, y: str, objects: dict[str, list[str]], reps=10000, seed=20260901, limit=GROUP_LIMIT,
    key: str | None = None,
) -> DataFrame:
    """rep and one rank correlation per object, resampling whole clusters with replacement.

    A drawn cluster's rows enter with its multiplicity as a weight; ranks are recomputed in every replicate as weighted
    average-tie ranks.  Up to ``ROWS_IN_TASK`` rows, each run of replicates is one task that holds all rows and only
    replicates x objects come out.

    Beyond that, tasks hold two strips of the rows; see :func:`_rhos_by_strips`.  ``key`` is not needed for it."""
    spark = df.sparkSession
    cols = sorted({c for cs in objects.values() for c in cs})
    rows = df.select(cluster, y, *cols)
    per = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    n, n_clusters = per.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    fits_one_task = limit is None or n <= min(limit, ROWS_IN_TASK)
    ids = ordinal(df.select(cluster).distinct(), [], [cluster], "_c", None if fits_one_task else 0)
    ids = ids.select(F.col("_c").alias("hit"), cluster)
    own = {c: f"v{i}" for i, c in enumerate([y, *cols])}
    names = [own[c] for c in cols]
    at = broadcast_if_small(ids.select(F.col("hit").alias("c"), F.col(cluster).alias("_id")))
    one = rows.select(F.col(cluster).alias("_g"), *[F.col(c).alias(v) for c, v in own.items()])
    one = one.join(at, F.col("_g").eqNullSafe(F.col("_id"))).select("c", *own.values())
    if fits_one_task:
        slabs = _slabs(spark, 1, reps)
        one = one.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
        schema = "rep int, " + ", ".join(f"rho_{i} double" for i in range(len(cols)))
        boot = _apart(one, slabs, "slab").groupBy("slab").applyInArrow(_rhos(n_clusters, reps, slabs, seed, own[y], names), schema)
    else:
        boot = _rhos_by_strips(one, own[y], names, n, n_clusters, reps, seed)
    rho = {c: F.col(f"rho_{i}") for i, c in enumerate(cols)}
    return boot.select("rep", *[(sum((rho[c] for c in cs[1:]), rho[cs[0]]) / len(cs)).alias(name) for name, cs in objects.items()])


def contrast(boot: DataFrame, a: str, b: str) -> DataFrame:
    return summarize(boot.select((F.col(a) - F.col(b)).alias("delta")))


def verdict(df: DataFrame, lo="ci_lo", hi="ci_hi") -> DataFrame:
    v = F.when(F.col(lo) > 0, "resolved-positive").when(F.col(hi) < 0, "resolved-negative").otherwise("unresolved")
    return df.withColumn("verdict", v)


def resolved_everywhere(df: DataFrame, keys: list[str], screen="screen") -> DataFrame:
    """Whether the same resolved verdict holds in every screen."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(
        F.count_distinct(screen).alias("n_screens"),
        F.bool_and(F.col("verdict") == "resolved-positive").alias("positive_in_all"),
        F.bool_and(F.col("verdict") == "resolved-negative").alias("negative_in_all"),
    )


def matched_cells(cells: DataFrame, keys: list[str], n: int, seeds: list[int]) -> DataFrame:
    """n cells per group and seed without replacement; groups with fewer are left out.

    ``row_number <= n`` is pruned before the shuffle, so a huge group ships n cells per task."""
    s = F.explode(F.array(*[F.lit(x) for x in seeds])).alias("seed")
    o = cells.select("*", s).withColumn("_o", order_key(F.col("seed"), F.col("cell_id")))
    w = Window.partitionBy(*keys, "seed").orderBy("_o", "cell_id")
    picked = o.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    enough = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= n).drop("_k")
    return picked.drop("_o", "_rn").join(enough, keys, "left_semi")


def retention(sizes: DataFrame, screen: str, ns: list[int]) -> DataFrame:
    q = F.percentile("n_cells", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    per = [F.count_if(F.col("n_cells") >= n).alias(f"kept_{n}") for n in ns]
    out = sizes.groupBy(screen).agg(F.count(F.lit(1)).alias("n_groups"), q, *per)
    return out.select(
        screen, "n_groups", *[f"kept_{n}" for n in ns],
        *[(F.col("n_groups") - F.col(f"kept_{n}")).alias(f"dropped_{n}") for n in ns],
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"),
    )


def common_band(sizes: DataFrame, screen: str) -> DataFrame:
    """Band from the largest lower to the smallest upper quartile, and the groups inside it."""
    q = sizes.groupBy(screen).agg(F.percentile("n_cells", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    band = q.agg(F.max(F.col("q")[0]).alias("lower"), F.min(F.col("q")[1]).alias("upper"))
    lo, hi = band.select("lower").scalar(), band.select("upper").scalar()
    return sizes.groupBy(screen).agg(
        F.count_if(F.col("n_cells").between(lo, hi)).alias("n_in_band")
    ).select(screen, "n_in_band", lo.alias("lower"), hi.alias("upper"), (lo < hi).alias("adequate"))


def stratified_folds(df: DataFrame, cls: str, key: str, k: int, seed, limit=GROUP_LIMIT) -> DataFrame:
    """0-based fold per row: each class in keyed random order, cut into k runs, larger ones first."""
    o = df.withColumn("_o", order_key(seed, F.col(key)))
    o = ordinal(o, [cls], ["_o"], "_p", limit)
    base, extra = F.floor(F.col("_p_n") / k), F.col("_p_n") % k
    cut = extra * (base + 1)
    fold = F.when(F.col("_p") < cut, F.floor(F.col("_p") / (base + 1))).otherwise(
        extra + F.floor((F.col("_p") - cut) / F.greatest(base, F.lit(1)))
    )
    return o.withColumn("fold", fold.cast("int")).drop("_o", "_p", "_p_n")


def context_batches(df: DataFrame, context: str, key: str, batch_size: int, seed, limit=GROUP_LIMIT) -> DataFrame:
    """Batch number per row: every batch takes the same number of rows (at least 4) from each
    context, and the epoch ends when a context has fewer than two left."""
    n_ctx = df.agg(F.count_distinct(context).alias("c")).scalar()
    o = ordinal(df.withColumn("_o", order_key(seed, F.col(key))), [context], ["_o"], "_p", limit)
    o = o.withColumn("_take", F.greatest(F.lit(4).cast("bigint"), F.floor(F.lit(batch_size) / F.greatest(n_ctx, F.lit(1)))))
    o = o.withColumn("batch_no", F.floor(F.col("_p") / F.col("_take")))
    smallest = df.groupBy(context).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).scalar()
    return o.where(smallest - F.col("batch_no") * F.col("_take") >= 2).drop("_o", "_p", "_p_n", "_take")
