"""Words of an Arrow text column as 64-bit hashes, computed over whole buffers with NumPy.

Used inside Spark's Arrow tasks only.  A slice of rows is handled at a time, so memory follows ``SLICE_BYTES`` or the
longest single text, not the batch.
"""
from __future__ import annotations

import numpy as np

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20
#: Rows handled at once inside a task, however short they are.
SLICE_ROWS = 1 << 14
#: Odd multipliers; powers are inverted modulo 2**64.
P = 0x9E3779B97F4A7C15
Q1, Q2 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: One document-ending token for language models.
END = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(texts, most_rows: int = SLICE_ROWS):
    """(first row, rows as bytes, offsets) of consecutive slices of an Arrow text array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
        to = min(to, at + most_rows, n)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return _LOWER[data]


def spans(data: np.ndarray, ends: np.ndarray):
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    stops = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    rows = np.searchsorted(ends, starts, side="right") - 1
    return starts, stops, rows


class WordHasher:
    """Hashes words by prefix sums of a polynomial; keeps its tables of powers between slices."""

    def __init__(self):
        self.n = -1

    def __call__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if len(data) > self.n:
            self.n = max(len(data), SLICE_BYTES)
            self.up, self.down = powers(P, self.n), powers(pow(P, -1, 1 << 64), self.n)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return mix((sums[stops] - sums[starts]) * self.down[starts] if len(starts) else np.zeros(0, np.uint64))


def first_words(rows: np.ndarray, n: int) -> np.ndarray:
    """Index of each row's first word, and the number of words at the end: n + 1 offsets."""
    return np.searchsorted(rows, np.arange(n + 1), side="left")


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are missing."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(Q1) + words[i : i + n]
    return mix(out + np.uint64(k))
