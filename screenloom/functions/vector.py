"""Expressions over ``array<double|float>`` columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(x) -> Column:
    return F.aggregate(_d(x), F.lit(0.0), lambda a, e: a + e)


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_d(x), _d(y), lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e)


def norm(x) -> Column:
    return F.sqrt(F.aggregate(_d(x), F.lit(0.0), lambda a, e: a + e * e))


def cosine(x, y) -> Column:
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def subtract(x, y) -> Column:
    return F.zip_with(_d(x), _d(y), lambda a, b: a - b)


def magnitude(x) -> list[Column]:
    """The four row scalars: mean |x|, Euclidean norm, max |x|, population SD."""
    v = _d(x)
    n = F.size(v).cast("double")
    absx = F.transform(v, lambda e: F.abs(e))
    # bound as an element, the mean is taken once a row and not once a coordinate
    about = lambda mean: F.aggregate(F.transform(v, lambda e: (e - mean) * (e - mean)), F.lit(0.0), lambda a, e: a + e)
    ss = F.transform(F.array(vsum(v) / n), about)[0]
    return [
        (vsum(absx) / n).alias("mean_abs"),
        norm(v).alias("l2"),
        F.array_max(absx).alias("max_abs"),
        F.sqrt(ss / n).alias("sd"),
    ]


def repair(e: Column, limit: float = 10.0) -> Column:
    """NaN becomes 0, infinities become the limit of their sign; clip comes last."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.nanvl(e, F.lit(0.0))))


def non_finite(e: Column) -> Column:
    return F.isnan(e) | (F.abs(e) == F.lit(float("inf")))


def repair_vector(x, limit: float = 10.0) -> Column:
    return F.transform(_d(x), lambda e: repair(e, limit))


def count_non_finite(x) -> Column:
    return F.size(F.filter(_d(x), non_finite))
