"""Near-duplicate documents: circulant MinHash, bands, exact Jaccard, components.

One random permutation breaks up the shingle numbering; a second one, shifted by one more step for every coordinate, gives
the whole signature, so two permutations replace one for each coordinate.  Bands of coordinates name buckets; documents that
share a bucket are compared on their full shingle sets, first with the bucket's centre, then with those that it did not link.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.llm.graph import labels
from screenloom.llm.wordhash import Q1, Q2, WordHasher, first_words, gram_hashes, lowered, mix, powers, row_slices, spans
from screenloom.session import durable

#: 28 bands of 5 coordinates: a pair at similarity 0.85 meets in no band with probability (1 - 0.85**5)**28 = 7e-8.
BANDS, ROWS = 28, 5
SHINGLE = 5
#: Numerator and denominator of the least similarity.
LEAST = (85, 100)
#: Members of a bucket are compared in blocks of at most about this many documents or shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles of both blocks that are counted at once.
COLUMNS = 4096
SHIFT = 0x9E3779B1


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets of 64-bit hashes: a row of 32-bit minima for each set."""
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    if not sets:
        return out
    # first permutation: the mixed upper half of the hash
    place = np.concatenate([mix(s) >> np.uint64(32) for s in sets]).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    for k in range(coordinates):
        # second permutation, its argument shifted around the circle of 2**32 places
        out[:, k] = np.minimum.reduceat(_permute(place + np.uint32(k * SHIFT & 0xFFFFFFFF)), begin)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(Q2) + sig[:, b * rows + r].astype(np.uint64))
        keys[:, b] = key
    return keys.view(np.int64)


def shingle_sets(texts, shingle: int) -> Iterator[tuple[int, list, list]]:
    """(first row, sets, classes) by slices of an Arrow text array.

    The class is 16 bytes that stand for the whole word sequence; both are None for a text without words."""
    hasher = WordHasher()
    for at, data, ends in row_slices(texts):
        data = lowered(data)
        starts, stops, rows = spans(data, ends)
        words = hasher(data, starts, stops)
        first = first_words(rows, len(ends) - 1)
        grams = gram_hashes(words, shingle)
        longest = int(np.diff(first).max(initial=0))
        scale = powers(Q1, longest), powers(Q2, longest)
        sets, classes = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = words[a:b]
            if a == b:
                sets.append(None)
                classes.append(None)
                continue
            ids = [mix(np.array([(own * s[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)) for s in scale]
            classes.append(ids[0].tobytes() + ids[1].tobytes())
            sets.append(np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else gram_hashes(own, b - a))
        yield at, sets, classes


def _profiles(shingle: int, bands: int, rows: int):
    """Arrow task: (doc_id, text) to the columns of :func:`profiles`."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, sets, classes in shingle_sets(batch["text"], shingle):
                full = [s for s in sets if s is not None]
                keys = band_keys(signatures(full, bands * rows), bands, rows)
                lengths = np.array([0 if s is None else bands for s in sets], dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, len(sets)),
                        pa.array([0 if s is None else len(s) for s in sets], pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "cls", "bands"],
                )

    return run


def profiles(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, cls, bands``: size of the shingle set, the class of equal word sequences, a key for each band."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(
        _profiles(shingle, bands, rows), "doc_id bigint, n_shingles bigint, cls binary, bands array<bigint>"
    )


def _sets(shingle: int):
    """Arrow task: rows with a text and the class expected of it; other texts under the same id fall out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [n for n in batch.schema.names if n != "text"]
            for at, sets, classes in shingle_sets(batch["text"], shingle):
                part = batch.select(keep).slice(at, len(sets))
                same = [i for i, (c, e) in enumerate(zip(classes, part["cls"].to_pylist())) if c == e]
                part = part.take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([sets[i].tobytes() for i in same], pa.binary())], names=[*keep, "items"]
                )

    return run


def similar(left: list[np.ndarray], right: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """Index pairs with intersection / union of at least ``least``: exact counts over the shingles that both sides hold."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
    in_a = np.flatnonzero((at_a < len(both)) & (both[np.minimum(at_a, len(both) - 1)] == a)) if len(both) else np.zeros(0, int)
    in_b = np.flatnonzero((at_b < len(both)) & (both[np.minimum(at_b, len(both) - 1)] == b)) if len(both) else np.zeros(0, int)
    order_a, order_b = in_a[np.argsort(at_a[in_a], kind="stable")], in_b[np.argsort(at_b[in_b], kind="stable")]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(both), COLUMNS):
        sides = []
        for at, row, order, n in ((at_a, row_a, order_a, len(left)), (at_b, row_b, order_b, len(right))):
            lo, hi = np.searchsorted(at[order], [c, c + COLUMNS])
            own = order[lo:hi]
            m = np.zeros((n, min(COLUMNS, len(both) - c)), dtype=np.float32)
            m[row[own], at[own] - c] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    size = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    num, den = least
    return np.argwhere(den * common.astype(np.int64) >= num * (size - common.astype(np.int64)))


def _groups(table, keys: list[str]):
    """Row numbers of each group of equal ``keys`` in an Arrow table."""
    rows: dict = {}
    for i, key in enumerate(zip(*(table[k].to_pylist() for k in keys))):
        rows.setdefault(key, []).append(i)
    return rows.values()


def _linked(pairs: list[tuple[bytes, bytes]]):
    import pyarrow as pa

    return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})


def _star_links(least: tuple[int, int]):
    """Grouped Arrow task over some (centre, part) groups: the members that are linked with their centre."""
    num, den = least

    def run(table):
        cls, items, centre, is_centre = (table[c].to_pylist() for c in ("cls", "items", "centre", "is_centre"))
        out = []
        for rows in _groups(table, ["centre", "part"]):
            own = next((np.frombuffer(items[i], np.uint64) for i in rows if is_centre[i]), None)
            for i in rows if own is not None else ():
                if not is_centre[i]:
                    other = np.frombuffer(items[i], np.uint64)
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[at] == other).sum())
                    if den * both >= num * (len(own) + len(other) - both):
                        out.append((cls[i], centre[i]))
        return _linked(out)

    return run


def _rest_links(least: tuple[int, int]):
    """Grouped Arrow task over some (bucket, step, lo, hi) groups: links between trees, told as pairs of their roots."""

    def run(table):
        cls, items, block, upper, roots, lo, hi = (table[c].to_pylist() for c in ("cls", "items", "block", "upper", "root", "lo", "hi"))
        out = set()
        for rows in _groups(table, ["key", "step", "lo", "hi"]):
            # a text may have come twice, from rows that share an id
            first = {cls[i]: i for i in reversed(rows)}
            rows = sorted(first.values(), key=lambda i: cls[i])
            left = [i for i in rows if not upper[i] and block[i] == lo[i]]
            right = [i for i in rows if block[i] == hi[i]]
            if lo[rows[0]] != hi[rows[0]]:  # the other way round: upper rows of the lower block
                left, right = [i for i in rows if not upper[i]], rows
            if not left or not right:
                continue
            set_of = lambda at: [np.frombuffer(items[i], np.uint64) for i in at]
            for x, y in similar(set_of(left), set_of(right), least):
                a, b = roots[left[int(x)]], roots[right[int(y)]]
                if a != b:
                    out.add((min(a, b), max(a, b)))
        return _linked(sorted(out))

    return run


def _with_sets(source: DataFrame, members: DataFrame, shingle: int, columns: str) -> DataFrame:
    """``members`` (``ref``, ``cls`` and others) with the shingle sets of their texts."""
    names = [c for c in members.columns if c != "ref"]
    texts = source.join(broadcast_if_small(members), "ref").select(*names, "text")
    return texts.mapInArrow(_sets(shingle), columns + ", items binary")


def _tasks(members: DataFrame) -> int:
    """Groups are dealt to so many tasks that one has about ``BLOCK_SHINGLES`` shingles."""
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // BLOCK_SHINGLES)


def _parts(size) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(size) / BLOCK_SHINGLES)).cast("int").alias("parts")


def _deal(column: str, parts) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), F.col(column)), parts).cast("int")


def trees(source: DataFrame, classes: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """``node, root``: classes connected by links; a class without any is left out.

    Every bucket first compares its members with one of them, its centre; that links nearly all of a group of copies at a cost in
    proportion to its size.  Buckets whose other members are still in several trees then compare those, class by class of
    set sizes and block by block, since sets whose sizes differ by more than ``least`` cannot be linked.  A pair that
    shares a bucket is compared in one of the two steps unless both are in one tree already.
    """
    num, den = least
    keyed = classes.select(F.explode("bands").alias("key"), "cls", F.col("rep").alias("ref"), F.col("n_shingles").alias("n"))
    near = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num
    centres = keyed.groupBy("key").agg(F.min(F.struct("cls", "ref", "n")).alias("c"), F.max("cls").alias("other"))
    centres = centres.where(F.col("c.cls") != F.col("other")).select("key", F.col("c.cls").alias("centre"), F.col("c.ref").alias("c_ref"), F.col("c.n").alias("c_n"))
    shared = durable(keyed.join(centres, "key"))  # members of buckets with company
    stars = shared.where((F.col("cls") != F.col("centre")) & near(F.col("n"), F.col("c_n")))
    stars = durable(stars.select("cls", "ref", "n", "centre", "c_ref", "c_n").distinct())
    parts = stars.groupBy("centre", "c_ref", "c_n").agg(_parts("n"))
    one = stars.join(parts.select("centre", "parts"), "centre").select("cls", "ref", "n", "centre", _deal("cls", F.col("parts")).alias("part"), F.lit(False).alias("is_centre"))
    own = parts.select(
        F.col("centre").alias("cls"), F.col("c_ref").alias("ref"), F.col("c_n").alias("n"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_centre")
    )
    asked = one.unionByName(own)
    n = _tasks(stars)
    sets = _with_sets(source, asked.select("ref", "cls", "centre", "part", "is_centre"), shingle, "cls binary, centre binary, part int, is_centre boolean")
    links = sets.groupBy(F.pmod(F.xxhash64("centre", "part"), F.lit(n)).alias("task")).applyInArrow(_star_links(least), "a binary, b binary")
    first = durable(labels(links, "a", "b"))

    rest = shared.where(F.col("cls") != F.col("centre")).join(first.withColumnRenamed("node", "cls"), "cls", "left")
    rest = rest.select("key", "cls", "ref", "n", F.coalesce("root", "cls").alias("root"))
    several = rest.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    step = F.floor(F.log(F.col("n")) / F.lit(math.log(den / num))).cast("int") if num < den else F.col("n").cast("int")
    lower = rest.join(several, "key").select("*", step.alias("step"), F.lit(False).alias("upper"))
    # two linked sets have the same step or neighbouring ones
    both = durable(lower.unionByName(lower.withColumn("step", F.col("step") - 1).withColumn("upper", F.lit(True))))
    blocks = both.groupBy("key", "step").agg(_parts("n"), F.bool_or(~F.col("upper")).alias("any"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    blocks = blocks.where("any AND r0 <> r1").select("key", "step", "parts")
    dealt = both.join(blocks, ["key", "step"]).withColumn("block", _deal("cls", F.col("parts")))
    other = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = other.select("ref", "cls", "key", "step", "upper", "root", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "n")
    n = _tasks(both)
    columns = "cls binary, key bigint, step int, upper boolean, root binary, block int, lo int, hi int"
    sets = _with_sets(source, other.drop("n"), shingle, columns)
    links = sets.groupBy(F.pmod(F.xxhash64("key", "step", "lo", "hi"), F.lit(n)).alias("task")).applyInArrow(_rest_links(least), "a binary, b binary")
    second = labels(links, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("next"))
    # a class that the first step left alone is its own root
    alone = second.select(F.col("root").alias("node")).join(first, "node", "left_anti").select("node", F.col("node").alias("root"))
    return first.unionByName(alone).join(second, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def merged(source: DataFrame, seen: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """``cls, component``: the smallest ``ref`` of all classes that links connect.

    ``source`` has ``ref, text``, and ``seen`` the columns of :func:`profiles` with ``ref`` for ``doc_id``."""
    classes = durable(
        seen.where(F.col("ref").isNotNull() & F.col("cls").isNotNull()).groupBy("cls").agg(
            F.min("ref").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
        )
    )
    linked = durable(trees(source, classes, shingle, least).withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls"))
    least_id = linked.groupBy("root").agg(F.min("rep").alias("component"))
    joined = linked.join(least_id, "root").select("cls", "component")
    # stored, so that the join that follows is a plain one whose hot classes the engine can split
    return durable(classes.select("cls", "rep").join(joined, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component")))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, least: tuple[int, int] = LEAST
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Words are runs of non-space bytes after A-Z is lower-cased; a set holds distinct runs of ``shingle`` words, or the one
    whole sequence of a shorter text.  Two documents are linked when den * intersection >= num * union.  Copies with equal
    word sequences are one class, so a group of copies costs one comparison, and only classes that share a bucket are
    compared.  ``component_id`` is the smallest ``doc_id`` that links lead to.

    Null, empty or blank texts have no shingles and stand alone.  A row without ``doc_id`` links with nothing, has a null
    ``component_id`` and is kept.  Repeated rows each get the same answer; rows that share an id but not a text are
    compared as separate texts.  An empty table gives no rows.
    """
    seen = durable(profiles(docs, shingle, bands, rows).withColumnRenamed("doc_id", "ref"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("ref"), F.col("text").cast("string").alias("text"))
    of_class = merged(source, seen, shingle, least)
    out = seen.select(F.col("ref").alias("doc_id"), "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of ``docs`` for each component, and every row without words; all columns stay as they are.

    Rows are told apart by a number of their own and not by ``doc_id``: of rows with linked texts the one with the smallest
    ``doc_id`` stays (rows without id come last, equal ids in the order of the input), whatever else they hold.  So repeated
    rows leave one, rows without id are compared like others, and rows that share an id but no text both stay.
    Null, empty and blank texts are nobody's copies.  An empty table stays empty.
    """
    # written once: a row's number must not change while others are compared with it
    name = next(c for c in (f"_row{'_' * i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    own = durable(docs.withColumn(name, F.monotonically_increasing_id()))
    ids = own.select(F.col(name).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("id"))
    seen = durable(profiles(ids, shingle, bands, rows).withColumnRenamed("doc_id", "ref"))
    of_class = merged(ids.select(F.col("doc_id").alias("ref"), "text"), seen, shingle, least)
    named = seen.where(F.col("cls").isNotNull()).select("ref", "cls").join(of_class, "cls").join(ids.select(F.col("doc_id").alias("ref"), "id"), "ref")
    placed = durable(named.select("ref", "component", F.struct(F.col("id").isNull().alias("none"), "id", "ref").alias("place")))
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    gone = placed.join(first, "component").where(F.col("ref") != F.col("first.ref")).select(F.col("ref").alias(name))
    return own.join(broadcast_if_small(durable(gone)), name, "left_anti").drop(name)
