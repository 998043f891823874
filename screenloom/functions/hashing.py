"""Keyed random numbers: the same row key and seed give the same draw on any cluster layout."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO32 = 4294967296.0


def _digest(seed, keys) -> Column:
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def _unit(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(TWO32)


def uniform(seed, *keys) -> Column:
    """Uniform on [0, 1)."""
    return _unit(_digest(seed, keys), 1)


def four_uniforms(seed, *keys) -> list[Column]:
    """Four independent uniforms from the four words of one digest."""
    d = _digest(seed, keys)
    return [_unit(d, 1 + 8 * i) for i in range(4)]


def order_key(seed, *keys) -> Column:
    """A string whose order is a keyed random permutation; 128 bits, so ties do not occur."""
    return _digest(seed, keys)


def normal(seed, *keys) -> Column:
    return _box_muller(_digest(seed, keys))


def normals(seed, key: Column, dim: int) -> Column:
    """Vector of standard normals; seed and key are joined once a row, each element's digest is made once and then used twice."""
    head = F.concat_ws("|", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), key.cast("string"))
    each = lambda h: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.md5(F.concat_ws("|", h, i.cast("string"))))
    return F.transform(F.transform(F.array(head), each)[0], _box_muller)


def _box_muller(d: Column) -> Column:
    """Standard normal from two words of one digest."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _unit(d, 1))) * F.cos(
        F.lit(2.0 * math.pi) * _unit(d, 9)
    )
