"""Bootstrap draws that a task can repeat for its own rows, for all replicates, without seeing the others.

Rows lie in blocks.  A replicate's n draws are dealt to the blocks by halving: at every node of a binary tree over the blocks a
keyed binomial number goes to the left.  Inside its block, a draw hits the row that a keyed hash of its number names.  So
the multiplicities of a block's rows follow from seed, replicate, block and sizes alone, and together they are multinomial.
"""
from __future__ import annotations

import numpy as np

#: Rows of one block; up to here the tree is a single leaf, which plain SQL can repeat.
BLOCK = 1 << 18
#: Draws whose hits are made at once.
AT_ONCE = 1 << 20
#: Draws that are hashed at once, so that they stay in a core's cache.
IN_CACHE = 1 << 15
# The multipliers of a 32-bit finalising hash, and the golden ratio as a 32-bit fraction.
M1, M2, PHI = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1
U = np.uint32


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    h = h ^ (h >> U(16))
    h = h * U(M1)
    h ^= h >> U(13)
    h *= U(M2)
    h ^= h >> U(16)
    return h


def key(seed: int, rep: int, block: int) -> np.uint32:
    first = fmix(np.array([(seed + rep * PHI) & 0xFFFFFFFF], dtype=np.uint32))
    return fmix(first ^ U((block * M1 + 1) & 0xFFFFFFFF))[0]


def numbers(start: int, stop: int) -> np.ndarray:
    """Hashes of the draws' numbers, the same for every replicate; folded by the first step of the next hash, which is linear."""
    h = fmix(((np.arange(start, stop, dtype=np.uint64) + np.uint64(1)) * np.uint64(PHI) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return h ^ (h >> U(16))


def hits(key: np.uint32, numbers: np.ndarray, n: int) -> np.ndarray:
    """The row out of n that each draw names: ``fmix`` of its hash and the key, as a fraction of n; in pieces that stay in a cache."""
    key = U(key ^ (key >> U(16)))
    out = np.empty(len(numbers), dtype=np.int64)
    held = np.empty((2, min(len(numbers), IN_CACHE)), dtype=U)
    bits = n.bit_length() - 1
    for at in range(0, len(numbers), IN_CACHE):
        to = out[at : at + IN_CACHE]
        h, s = held[:, : len(to)]
        np.bitwise_xor(numbers[at : at + IN_CACHE], key, out=h)
        h *= U(M1)
        h ^= np.right_shift(h, U(13), out=s)
        h *= U(M2)
        h ^= np.right_shift(h, U(16), out=s)
        if bits and n == 1 << bits:
            to[:] = np.right_shift(h, U(32 - bits), out=s)
        else:
            to[:] = h
            whole = to.view(np.uint64)
            whole *= np.uint64(n)
            whole >>= np.uint64(32)
    return out


def block_rows(n: int, block: int, size: int) -> int:
    return min(size, n - block * size)


def block_draws(seed: int, rep: int, n: int, block: int, size: int) -> int:
    """How many of the n draws of a replicate fall into one block of ``size`` rows."""
    lo, hi, k = 0, -(-n // size), n
    while hi - lo > 1 and k:
        mid = (lo + hi) // 2
        left, all_ = mid * size - lo * size, min(n, hi * size) - lo * size
        rng = np.random.Generator(np.random.Philox(key=[np.uint64(seed) << np.uint64(32) | np.uint64(rep), np.uint64(lo) << np.uint64(32) | np.uint64(hi)]))
        to_left = int(rng.binomial(k, left / all_))
        lo, hi, k = (lo, mid, to_left) if block < mid else (mid, hi, k - to_left)
    return k


def multiplicities(seed: int, rep: int, n: int, block: int = 0, size: int | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """How often each row of the block is drawn.  ``known`` may hold :func:`numbers` from 0 on, made once for many replicates."""
    size = size or max(n, 1)
    rows, k = block_rows(n, block, size), block_draws(seed, rep, n, block, size)
    own = key(seed, rep, block)
    out = np.zeros(rows, dtype=np.int64)
    for start in range(0, k, AT_ONCE):
        stop = min(k, start + AT_ONCE)
        g = known[start:stop] if known is not None and stop <= len(known) else numbers(start, stop)
        drawn = np.bincount(hits(own, g, rows), minlength=rows)
        out = out + drawn if start else drawn
    return out
