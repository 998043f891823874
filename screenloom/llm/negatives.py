"""Hard negatives by Kronecker-packed products.

The components of several candidates are biased to be non-negative and laid side by side in separated fields of one wide
integer.  Multiplying an anchor's component with that integer multiplies all of them at once; after the sum over the
components, each field holds one exact inner product.  Fields are as wide as the block's largest sum needs: unsigned words
of 64 bits hold two or more small ones, larger ones go through integers without a limit.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from screenloom.session import durable

#: Components of the anchors and of the candidates in one pair of blocks.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 1 << 20, 1 << 22
#: Components for which another block of candidates is made while there are cores for it.
LEAST_BLOCK = 1 << 16
#: Scores held at once inside a task.
SCORES = 1 << 21
#: Candidates that share one integer when 64 bits are too few.
WIDE_FIELDS = 8
LONG = (1 << 63) - 1


def quantized(rows: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) of every component; shorter vectors end in zeros."""
    width = max((len(r) for r in rows), default=0)
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    if np.abs(x).max(initial=0) < (1 << 52) / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [[math.floor(v * scale) if abs(v) < (1 << 52) / scale else int(v) * scale for v in r] for r in x.tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def pack(candidates: np.ndarray, width: int, fields: int, bias: int) -> np.ndarray:
    """One row of wide integers for each component: ``fields`` biased candidates in fields of ``width`` bits."""
    n, dim = candidates.shape
    wide = np.uint64 if width * fields <= 64 else object
    room = np.zeros((-(-n // fields) * fields, dim), dtype=candidates.dtype)
    room[:n] = candidates + bias
    if wide is object:
        room = room.astype(object)
    words = np.zeros((len(room) // fields, dim), dtype=wide)
    for f in range(fields):
        part = room[f::fields]
        words = words + (part << (width * f) if wide is object else part.astype(np.uint64) << np.uint64(width * f))
    return np.ascontiguousarray(words.T)


def layout(anchors: np.ndarray, candidates: np.ndarray) -> tuple[int, int, int]:
    """Bits of a field, fields of a word and the candidates' bias; no sum of the block outgrows its field."""
    bias = max(0, -int(candidates.min(initial=0)))
    top = int(candidates.max(initial=0)) + bias
    most = max((sum(abs(v) for v in row) for row in anchors.tolist()), default=0) * top
    width = most.bit_length() + 1
    return width, 64 // width or WIDE_FIELDS, bias


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all candidates, exact; those past 64 bits become the nearest long."""
    dim = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (anchors, candidates))
    width, fields, bias = layout(anchors, candidates)
    words = pack(candidates, width, fields, bias)
    wide = words.dtype
    half = 1 << (width - 1)
    level = sum(half << (width * f) for f in range(fields))
    sums = np.full((len(anchors), words.shape[1]), level, dtype=wide)
    scaled = anchors.astype(object) if wide == object else anchors.astype(np.int64).view(np.uint64)
    for d in range(dim):  # one multiplication of each anchor component with each word; 64-bit words wrap around
        sums += scaled[:, d, None] * words[d]
    out = np.empty((len(anchors), words.shape[1] * fields), dtype=object if wide == object else np.int64)
    mask = (1 << width) - 1
    for f in range(fields):
        if wide == object:
            out[:, f::fields] = ((sums >> (width * f)) & mask) - half
        else:
            field = (sums >> np.uint64(width * f)) & np.uint64(mask)
            out[:, f::fields] = field.astype(np.int64) - half
    own = anchors.astype(object).sum(axis=1) if wide == object else anchors.sum(axis=1)
    out = out[:, : len(candidates)] - (own * bias)[:, None]
    return out if wide != object else np.clip(out, -LONG - 1, LONG).astype(np.int64)


def _vectors(table, scale: int) -> np.ndarray:
    column = table["vec"].combine_chunks()
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return quantized([values[a:b] for a, b in zip(ends[:-1], ends[1:])], scale)


def _sorted(table):
    return table.sort_by([("vec_id", "ascending"), ("row", "ascending")])


def _slabs(anchors: np.ndarray, n: int):
    step = max(1, SCORES // max(n, 1))
    return (slice(i, i + step) for i in range(0, len(anchors), step))


def _positives(scale: int, most: int):
    """Cogrouped Arrow task over a pair of blocks: each anchor's best rows of its own label in the block."""

    def run(left, right):
        import pyarrow as pa

        cols: list[list] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            right = _sorted(right)
            a, c = _vectors(left, scale), _vectors(right, scale)
            la, lc = left["label"].to_numpy(), right["label"].to_numpy()
            rows, ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
            for label in np.unique(la):
                own, same = np.flatnonzero(la == label), np.flatnonzero(lc == label)
                for part in _slabs(own, len(same)) if len(same) else ():
                    s = products(a[own[part]], c[same])
                    for i, score in zip(own[part], s):
                        at = np.argsort(~score, kind="stable")[: most + 1]
                        at = at[rows[same[at]] != left["row"][int(i)].as_py()][:most]
                        cols[0] += [left["row"][int(i)].as_py()] * len(at)
                        cols[1] += [left["vec_id"][int(i)].as_py()] * len(at)
                        cols[2] += rows[same[at]].tolist()
                        cols[3] += ids[same[at]].tolist()
                        cols[4] += score[at].tolist()
        names = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score"]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, cols)})

    return run


def _share(score: int, num: int, den: int) -> tuple[int, int]:
    """Ceiling and floor of ``score * num / den``."""
    return -(-score * num // den), score * num // den


def _negatives(scale: int, most: int, low: tuple[int, int], high: tuple[int, int]):
    """Cogrouped Arrow task over a pair of blocks: for each anchor and positive the block's first rows inside the window."""

    def run(left, right):
        import pyarrow as pa

        cols: list[list] = [[] for _ in range(5)]
        if left.num_rows and right.num_rows:
            right = _sorted(right)
            a, c = _vectors(left, scale), _vectors(right, scale)
            la, lc = left["label"].to_numpy(), right["label"].to_numpy()
            rows, ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
            anchor_rows, wanted = left["row"].to_pylist(), left["wanted"].to_pylist()
            for part in _slabs(a, len(c)):
                for i, score in zip(range(*part.indices(len(a))), products(a[part], c)):
                    bounds = [(p, max(_share(p, *low)[0], -LONG - 1), _share(p, *high)[1]) for p in wanted[i]]
                    bounds = [b for b in bounds if b[1] <= b[2]]
                    if not bounds:
                        continue
                    least, top = min(b[1] for b in bounds), max(b[2] for b in bounds)
                    at = np.flatnonzero((lc != la[i]) & (score >= least) & (score <= top))
                    at = at[np.argsort(~score[at], kind="stable")]  # ~x is -x - 1 and never overflows
                    down = ~score[at]
                    for p, lo, hi in bounds:
                        k = int(np.searchsorted(down, ~hi))
                        take = at[k : k + most]
                        take = take[score[take] >= lo]
                        cols[0] += [anchor_rows[i]] * len(take)
                        cols[1] += [p] * len(take)
                        cols[2] += rows[take].tolist()
                        cols[3] += ids[take].tolist()
                        cols[4] += score[take].tolist()
        names = ["anchor_row", "positive_score", "negative_row", "negative_id", "negative_score"]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, cols)})

    return run


def hard_negatives(
    vectors: DataFrame, anchor: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 10,
    low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; other columns are ignored unless ``anchor`` or ``label`` name
    them.  Components become floor(scale * x).  Each row where ``anchor`` is true takes its first ``positives`` other rows of
    the same label, and for each of those the first ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` (numerator, denominator) of the positive's score; first means higher score, then smaller ``vec_id``.

    Rows without ``vec_id``, label or vector, or with a null or non-finite component, take no part.  Vectors of unequal length
    are filled up with zeros.  Repeated rows are separate rows: a copy of an anchor is a positive of it, and an anchor that is
    there twice has its answer twice.  A negative positive score has an empty window.  Scores past 64 bits count as the
    nearest long.  No anchors or an empty table give no rows.

    Anchors meet all rows block by block; a block holds a bounded number of components on either side, so a hot label only
    means more of its rows in every block.  Only each block's winners travel on.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (label if label is not None else F.col("label")).cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.coalesce(anchor if anchor is not None else F.col("vec_id") % 100 == 0, F.lit(False)).alias("is_anchor"),
    )
    whole = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(whole)
    rows = durable(given.withColumn("row", F.monotonically_increasing_id()))
    size = F.sum(F.size("vec").cast("bigint") + 1)
    total, asked = rows.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_anchor"), F.size("vec") + 1)), F.lit(0))).first()
    n_a = max(1, math.ceil(asked / ANCHOR_BLOCK))
    cores = int(spark.conf.get("spark.sql.shuffle.partitions")) // n_a
    n_c = max(1, min(cores, math.ceil(total / LEAST_BLOCK)), math.ceil(total / CANDIDATE_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = rows.where("is_anchor")

    def meet(left: DataFrame, task, schema: str) -> DataFrame:
        left = left.select([F.col(c).alias(c) for c in left.columns])  # its own columns, not those of the other side
        left = left.withColumn("a", deal(n_a)).withColumn("c", each(n_c))
        right = rows.select("row", "vec_id", "label", "vec").withColumn("c", deal(n_c)).withColumn("a", each(n_a))
        return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(task, schema)

    found = meet(
        anchors.select("row", "vec_id", "label", "vec"), _positives(scale, positives),
        "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint",
    )
    first = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    chosen = durable(found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives))
    wanted = chosen.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_set("positive_score").alias("wanted"))  # a handful each
    asking = anchors.join(wanted, "row").select("row", "label", "vec", "wanted")
    near = meet(
        asking, _negatives(scale, negatives, low, high),
        "anchor_row bigint, positive_score bigint, negative_row bigint, negative_id bigint, negative_score bigint",
    )
    order = Window.partitionBy("anchor_row", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.join(best, ["anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
