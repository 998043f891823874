"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily, longest piece first; then its shortest piece is exchanged for two unpacked ones that fill the
gap, widened by the piece taken out, more tightly.  Lengths are whole numbers up to the sequence length, so the choices
depend on how many pieces of each length are left and on nothing else: the packing is worked out on that small table, a
pattern of lengths at a time and as often as the table allows, and every piece then finds its place from its rank among
the pieces of its length.
"""
from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.session import durable

CAPACITY = 2048
#: Characters of text that are tokenised before rows are handed on.
SLICE_CHARS = 1 << 20
END = 0


def unicode_bytes() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself where printable, else the next free sign from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a byte-level BPE file of the ``tokenizers`` library whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    model, added = kept["model"], {t["content"]: t["id"] for t in kept["added_tokens"]}
    byte = unicode_bytes()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"]["".join(p)] for p in pairs]
    if order != sorted(order) or kept["normalizer"] or kept["pre_tokenizer"] != PRE_TOKENIZER:
        raise ValueError(f"{path}: not a plain byte-level vocabulary")
    return ranks, added


#: What the file must say about splitting, and the pattern that this stands for.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _pieces(ranks: dict[bytes, int], added: dict[str, int], pattern: str, capacity: int):
    """Arrow task: (doc_id, text) to the pieces of its documents, counted by length as they come."""

    def run(batches):
        import pyarrow as pa
        import tiktoken
        from pyspark import TaskContext

        codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            at = 0
            while at < len(texts):
                rows, size = [], 0
                cols: list[list] = [[] for _ in range(5)]
                while at < len(texts) and size < SLICE_CHARS:
                    text = texts[at].as_py() or ""
                    size += len(text)
                    tokens = np.array([*codec.encode(text, allowed_special="all"), END], dtype="<u4")
                    begin = [0, *range(len(tokens) - (len(tokens) - 1) // capacity * capacity, len(tokens), capacity)]
                    for piece, (a, b) in enumerate(zip(begin, [*begin[1:], len(tokens)])):
                        rows.append(at)
                        for col, v in zip(cols, (piece, a, b - a, zlib.crc32(tokens[a:b].tobytes()), seen[b - a])):
                            col.append(int(v))
                        seen[b - a] += 1
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]),
                        pa.array(np.full(len(rows), task, dtype=np.int32)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "place", "task"],
                )

    return run


def best_pair(lengths: list[int], left: Counter, least: int, most: int) -> tuple[int, int] | None:
    """Two available lengths a >= b with the largest sum of at most ``most`` and above ``least``; of those, the largest a."""
    best, lo = None, 0
    top = least
    hi = bisect.bisect_right(lengths, most) - 1
    while lo <= hi:
        a, b = lengths[hi], lengths[lo]
        if a + b > most:
            hi -= 1
            continue
        if a + b > top and (a != b or left[a] > 1):
            top, best = a + b, (a, b)
        lo += 1
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-two-fit over ``counts`` of each length: rows (length, first rank, sequences, first sequence, copies, offset).

    A row says that ranks from ``first rank`` on go, ``copies`` to a sequence, into that many sequences, the first copy at
    ``offset``.  The number of rows depends on the lengths, hardly on the number of pieces."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    lengths = sorted(left)
    used: Counter = Counter()
    rows, sequence = [], 0
    while lengths:
        gap, bin_ = capacity, Counter()
        at = len(lengths)
        while gap:  # greedily, longest first
            at = bisect.bisect_right(lengths, gap, 0, at) - 1
            if at < 0:
                break
            n = lengths[at]
            take = min(gap // n, left[n])
            bin_[n] += take
            gap -= take * n
        if gap and sum(bin_.values()) > 1:
            least = min(bin_)
            rest = left - bin_
            rest[least] += 0
            pair = best_pair(sorted(n for n in rest if rest[n] > 0), rest, least, gap + least)
            if pair:
                bin_[least] -= 1
                bin_.update(pair)
                bin_ += Counter()
        times = min(left[n] // c for n, c in bin_.items())
        offset = 0
        for n, c in sorted(bin_.items(), reverse=True):
            rows.append((n, used[n], times, sequence, c, offset))
            offset += n * c
            used[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
        sequence += times
    return rows


def _placed(rows: list[tuple[int, int, int, int, int, int]]):
    """Arrow task: pieces with their rank among the pieces of their length to their sequence and offset."""
    rows = sorted(rows)
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)
    by_length = {int(n): (int(a), int(b)) for n, a, b in zip(*_runs(table[:, 0]))}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                a, b = by_length[int(n)]
                own = np.flatnonzero(length == n)
                line = table[a:b][np.searchsorted(table[a:b, 1], rank[own], side="right") - 1]
                i = rank[own] - line[:, 1]
                sequence[own] = line[:, 3] + i // line[:, 4]
                offset[own] = line[:, 5] + i % line[:, 4] * n
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"]
            )

    return run


def _runs(sorted_values: np.ndarray):
    first = np.flatnonzero(np.diff(sorted_values, prepend=-1)) if len(sorted_values) else np.zeros(0, int)
    return sorted_values[first], first, np.append(first[1:], len(sorted_values))


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where each piece of each row of ``docs`` goes.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  ``path`` names a byte-level vocabulary file, read on the
    driver, and ``pattern`` the expression that splits texts before merges.  A document is the ids of its whole text and one
    id 0 as its end; one longer than ``capacity`` is cut from its end on, so that only its first piece is shorter.

    Null and empty texts are documents of one token.  Rows are packed as they are: repeated rows and rows without ``doc_id``
    each get places of their own.  Which of several pieces of one length goes where follows the order of the input.  An empty
    table gives no rows.

    Each task counts the pieces of its own rows by length; a piece's rank is that count plus what earlier tasks have, one
    number for each task and length.  So no length, however common, is sorted or gathered, and only the counts by length
    (``capacity`` numbers) and the plan made of them reach the driver.
    """
    ranks, added = vocabulary(path)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    cut = plain.mapInArrow(
        _pieces(ranks, added, pattern, capacity), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint, task int"
    )
    cut = durable(cut)
    sums = durable(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = durable(sums.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = cut.join(broadcast_if_small(before), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(
        _placed(plan(counts, capacity)),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
