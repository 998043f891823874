"""Collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly in a second pass, scored by their cuts.

A phrase is hashed to one of many hash partitions.  Each task sends, for every hash partition, a small sorted list of phrase
hashes with their counts; where the lists of a partition meet they are merged into one Misra-Gries summary whose capacity
exceeds the partition's mass divided by the threshold.  A summary knows how much it has taken off every counter, so a phrase
with at least ``threshold`` occurrences cannot be missing.  The survivors become a bit table of fixed size, and a second pass
over the texts counts every phrase whose bit is set, by its words.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.llm.wordhash import WordHasher, gram_hashes, lowered, mix, row_slices
from screenloom.session import durable

LONGEST, THRESHOLD, TOP = 5, 100, 2000
NO_LANG = "und"
#: Phrases that a task gathers before it sends their counts on.
CHUNK = 1 << 22
#: Words and bytes of text whose phrases are counted together in a task.
COUNT_BYTES = 1 << 24
#: Phrase occurrences for which a hash partition is made, and counters for each occurrence of threshold mass.
MASS, ROOM = 50_000_000, 4
#: Bits of the table of survivors (16 MB) and of one piece of it.
BITS, PIECE_BITS = 1 << 27, 1 << 16
_BOUND, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BOUND[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
U = np.uint64


def lang_seed(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Words:
    """The words of one slice of rows: hashes, places, pieces and languages."""

    def __init__(self, hasher: WordHasher, data: np.ndarray, ends: np.ndarray, seeds: np.ndarray):
        self.data = lowered(data)
        stop = _BOUND[self.data]
        word = np.zeros(len(data) + 2, dtype=bool)
        word[1:-1] = ~(stop | _GAP[self.data])
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[ends] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        self.stops = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        self.rows = np.searchsorted(ends, self.starts, side="right") - 1
        # neither count ever falls, so equal sums mean one row and one piece
        self.pieces = np.cumsum(stop)[self.starts] + self.rows if len(self.starts) else self.starts
        self.hashes = hasher(self.data, self.starts, self.stops)
        self.seeds = seeds[self.rows]

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and keys of all phrases of ``k`` words."""
        if len(self.starts) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.pieces[: len(self.pieces) - k + 1] == self.pieces[k - 1 :])
        return at, mix(gram_hashes(self.hashes, k)[at] ^ self.seeds[at])


def slices(batches) -> Iterator[tuple[Words, list[str]]]:
    """Words of consecutive slices of (lang, text) batches, with the languages of their rows."""
    hasher, known = WordHasher(), {}
    for batch in batches:
        names = [NO_LANG if x is None else x for x in batch["lang"].to_pylist()] if batch.num_rows else []
        for at, data, ends in row_slices(batch["text"]):
            own = names[at : at + len(ends) - 1]
            for n in own:
                if n not in known:
                    known[n] = lang_seed(n)
            yield Words(hasher, data, ends, np.array([known[n] for n in own], dtype=np.uint64)), own


def bit_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys) & U(BITS - 1)


def held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = bit_of(keys)
    return (table[bits >> U(3)] >> (bits & U(7)).astype(np.uint8)) & np.uint8(1) == 1


def _counts(lengths: range, table=None, partitions: int = 0):
    """Arrow task: (lang, text) to (lang, phrase, n); phrases of the given lengths whose bit is set in ``table``, or all.

    Counts are added up over ``COUNT_BYTES`` of text or ``CHUNK`` phrases, by 64-bit keys."""

    def run(batches):
        import pyarrow as pa

        parts: list = []
        size = found = 0

        def flush():
            keys = np.concatenate([p[1] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            n = np.diff(np.append(first, len(keys)))
            where = order[first]
            part_of = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])[where]
            within = where - np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])[part_of]
            by_part = np.argsort(part_of, kind="stable")
            lists: tuple[list, list, list] = ([], [], [])
            for p, (words, _, at, width, own) in enumerate(parts):
                mine = by_part[slice(*np.searchsorted(part_of[by_part], [p, p + 1]))]
                a = at[within[mine]]
                text = words.data.tobytes()
                spans = zip(words.starts[a].tolist(), words.stops[a + width[within[mine]] - 1].tolist())
                lists[0].extend(b" ".join(text[i:j].split()) for i, j in spans)
                lists[1].extend(own[r] for r in words.rows[a].tolist())
                lists[2].extend(n[mine].tolist())
            return pa.RecordBatch.from_arrays(
                [pa.array(lists[1], pa.string()), pa.array(lists[0], pa.binary()).cast(pa.string()), pa.array(lists[2], pa.int64())],
                names=["lang", "phrase", "n"],
            )

        for words, own in slices(batches):
            at, keys, width = [], [], []
            for k in lengths:
                i, key = words.phrases(k)
                if table is not None:
                    ok = held(table.value, placed(key, partitions))
                    i, key = i[ok], key[ok]
                at.append(i)
                keys.append(key)
                width.append(np.full(len(i), k, dtype=np.int8))
            keys = np.concatenate(keys)
            parts.append((words, keys, np.concatenate(at), np.concatenate(width), own))
            words.hashes = words.pieces = words.seeds = None
            size, found = size + len(words.data), found + len(keys)
            if size >= COUNT_BYTES or found >= CHUNK:
                yield flush()
                parts, size, found = [], 0, 0
        if parts:
            yield flush()

    return run


def squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers as zstd-compressed byte planes."""
    import pyarrow as pa

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def spread(data: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _summaries(partitions: int, longest: int, table):
    """Arrow task: (lang, text) to (part, n, items, counts), for each chunk and hash partition the phrases' 32-bit hashes
    (as differences) and counts.  Phrases with a word whose bit is not set are left out: they cannot be frequent."""

    def run(batches):
        import pyarrow as pa

        parts: list[np.ndarray] = []
        found = 0

        def flush():
            keys = np.concatenate(parts)
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            n = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            cut = np.searchsorted(keys, np.arange(partitions + 1, dtype=np.uint64) << U(32))
            low = (keys & U(0xFFFFFFFF)).astype(np.uint32)
            rows = [(h, b - a, squeezed(np.diff(low[a:b], prepend=np.uint32(0))), squeezed(n[a:b])) for h, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            cols = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "n", "items", "counts"])

        for words, _ in slices(batches):
            known = held(table.value, words.phrases(1)[1])
            for k in range(2, longest + 1):
                at, keys = words.phrases(k)
                ok = known[at].copy()
                for j in range(1, k):
                    ok &= known[at + j]
                parts.append(placed(keys[ok], partitions))
                found += len(parts[-1])
            if found >= CHUNK:
                yield flush()
                parts, found = [], 0
        if parts:
            yield flush()

    return run


def placed(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partition in the upper half, 32 bits of hash in the lower."""
    return (keys % U(partitions)) << U(32) | keys >> U(32)


class Summary:
    """A Misra-Gries summary of one hash partition.

    ``taken`` is what has been taken off every counter that was ever there, so an item's count is at most its counter plus
    ``taken``.  It stays below ``threshold``: where a further cut would break that, the capacity doubles instead, which happens
    only if the mass is more than the capacity was meant for."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = max(1, capacity), threshold, 0
        self.items, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, items: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((items, counts.astype(np.int64)))
        self.size += len(items)
        if self.size > self.capacity:
            self.merge()

    def merge(self) -> None:
        items = np.concatenate([self.items, *(w[0] for w in self.waiting)])
        counts = np.concatenate([self.counts, *(w[1] for w in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(items, kind="stable")
        items, counts = items[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.zeros(0, int)
        self.items, self.counts = items[first], np.add.reduceat(counts, first) if len(first) else counts
        while len(self.items) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.taken + cut >= self.threshold:
                self.capacity *= 2
                continue
            self.taken += cut
            keep = self.counts > cut
            self.items, self.counts = self.items[keep], self.counts[keep] - cut

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.items[self.counts + self.taken >= self.threshold]


def _merged(capacity: int, threshold: int):
    """Grouped Arrow task: the lists of one hash partition, as they come, to the bits of its survivors."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        own, part = Summary(capacity, threshold), 0
        for batch in batches:
            part = batch["part"][0].as_py()
            for n, items, counts in zip(batch["n"].to_pylist(), batch["items"], batch["counts"]):
                own.add(np.cumsum(spread(items.as_py(), n), dtype=np.uint32), spread(counts.as_py(), n))
        keys = U(part) << U(32) | own.survivors().astype(np.uint64)
        bits = bit_of(keys).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((bits // PIECE_BITS).astype(np.int32)), pa.array((bits % PIECE_BITS).astype(np.int32))], names=["piece", "bit"])

    # the group's type is read from the annotations, which are text here
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _word_bits(batches):
    """Arrow task: (lang, phrase) of single words to their bits."""
    import pyarrow as pa

    for batch in batches:
        bits = []
        for words, _ in slices([batch.rename_columns(["lang", "text"])]):
            bits.append(bit_of(words.phrases(1)[1]).astype(np.int64))
        bits = np.concatenate([np.zeros(0, np.int64), *bits])
        yield pa.RecordBatch.from_arrays([pa.array((bits // PIECE_BITS).astype(np.int32)), pa.array((bits % PIECE_BITS).astype(np.int32))], names=["piece", "bit"])


def _piece(key, table):
    import pyarrow as pa

    own = np.zeros(PIECE_BITS, dtype=bool)
    own[table["bit"].to_numpy()] = True
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})


def bit_table(bits: DataFrame):
    """The broadcast table of ``piece, bit`` rows: ``BITS`` bits, however many rows there are."""
    pieces = bits.distinct().groupBy("piece").applyInArrow(_piece, "piece int, data binary").toArrow()
    out = np.zeros(BITS // PIECE_BITS * (PIECE_BITS // 8), dtype=np.uint8).reshape(-1, PIECE_BITS // 8)
    for piece, data in zip(pieces["piece"].to_pylist(), pieces["data"]):
        out[piece] = np.frombuffer(data.as_py(), dtype=np.uint8)
    return bits.sparkSession.sparkContext.broadcast(out.ravel())


def frequent(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: ``lang, phrase, n`` of the words and of the longer phrases that come ``threshold`` times, and ``lang, n`` of
    all words.  See :func:`collocations`."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "lang string, phrase string, n bigint"
    every = durable(texts.mapInArrow(_counts(range(1, 2)), schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    totals = durable(every.groupBy("lang").agg(F.sum("n").alias("n")))
    words = every.where(F.col("n") >= threshold)
    mass = (longest - 1) * int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(mass / MASS))
    known = bit_table(words.select("lang", "phrase").mapInArrow(_word_bits, "piece int, bit int"))
    lists = texts.mapInArrow(_summaries(partitions, longest, known), "part int, n bigint, items binary, counts binary")
    capacity = ROOM * mass // (partitions * threshold) + 1
    survivors = bit_table(lists.groupBy("part").applyInArrow(_merged(capacity, threshold), "piece int, bit int"))
    counted = texts.mapInArrow(_counts(range(2, longest + 1), survivors, partitions), schema).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return words, durable(counted.where(F.col("n") >= threshold)), totals


def _cuts(phrases: DataFrame, every: DataFrame) -> DataFrame:
    """Each phrase's two parts at each cut, with their counts."""
    w = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k")
    cut = phrases.select("lang", "phrase", "n", w.alias("w"), k)
    cut = cut.select(
        "lang", "phrase", F.col("n").alias("a"), "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    for side, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(every.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    return cut


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``docs`` needs ``lang`` and ``text``; other columns are ignored.  A-Z is lower-cased, texts fall into pieces at
    ``.,;:!?`` and line ends, pieces into words at blanks and tabs.  Phrases have 2 to ``longest`` words and at least
    ``threshold`` occurrences ``a`` in the language; ``n`` counts its words.  A cut after k words gives the counts ``l`` and
    ``r`` of both parts and floor(1000 * a * n / (l * r)); the lowest cut counts, ties to the smaller k.  A phrase inside a longer
    one with as many occurrences is left out.

    A null language is ``und``, null and empty texts have no words, repeated rows count each time, equal scores go by ``a`` and
    then by the phrase's bytes, and an empty table gives no rows.

    Counts add up inside each task before they travel, so common phrases are a few rows; a merged summary holds at most
    ``ROOM`` times a partition's mass divided by the threshold.  Products are decimals of 38 digits.
    """
    words, phrases, totals = frequent(docs, longest, threshold)
    w = F.split("phrase", " ")
    longer = phrases.where(F.size(w) > 2)
    inner = longer.select("lang", F.explode(F.array(
        F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " ")
    )).alias("phrase"), "n")
    # a phrase one word longer is enough: between a phrase and a much longer one of equal count all counts are equal
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    left = phrases.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * 100))
    every = durable(words.select("lang", "phrase", "n").unionByName(phrases))
    cut = _cuts(durable(left.select("lang", "phrase", "n")), broadcast_if_small(every))
    cut = cut.join(F.broadcast(totals), "lang") if totals.count() <= 10_000 else cut.join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.withColumn("above", big("a") * 1000 * big("n")).withColumn("below", big("l") * big("r"))
    cut = cut.withColumn("score", F.expr("cast(above as decimal(38,0)) div cast(below as decimal(38,0))"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
