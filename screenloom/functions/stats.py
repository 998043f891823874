"""Aggregate expressions for evaluation metrics.

An undefined metric is NULL.  Nothing here uses ``F.corr``: under ANSI it throws on a constant or
one-row group, so correlations are built from moments and ``try_divide``.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r2(y, yhat) -> Column:
    """Coefficient of determination against the group's own mean; NULL when y is constant."""
    y, yhat = _c(y), _c(yhat)
    sse = F.sum((y - yhat) * (y - yhat))
    return F.lit(1.0) - F.try_divide(sse, F.var_pop(y) * F.count(y))


def pearson(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def weighted_pearson(a, b, w) -> Column:
    """Pearson of rows repeated ``w`` times, from weighted sums."""
    a, b, w = _c(a), _c(b), _c(w)
    n = F.sum(w)
    cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / n
    va = F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a) / n
    vb = F.sum(w * b * b) - F.sum(w * b) * F.sum(w * b) / n
    return F.when((va > 0) & (vb > 0), F.try_divide(cov, F.sqrt(va * vb)))


def mse(y, yhat) -> Column:
    d = _c(y) - _c(yhat)
    return F.avg(d * d)


def weighted_mse(y, yhat, w) -> Column:
    """Weighted mean squared error; a zero weight total falls back to the plain mean."""
    d = _c(y) - _c(yhat)
    w = _c(w)
    return F.coalesce(
        F.when(F.sum(w) > 0, F.try_divide(F.sum(w * d * d), F.sum(w))), F.avg(d * d)
    )


def bce_with_logits(y, logit) -> Column:
    """Binary cross-entropy in the form that does not overflow for large logits."""
    y, x = _c(y), _c(logit)
    return F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))


def partial_corr(r_xy, r_xz, r_yz) -> Column:
    """First-order partial correlation of x and y given z, from the three pairwise ones."""
    r_xy, r_xz, r_yz = _c(r_xy), _c(r_xz), _c(r_yz)
    left = (F.lit(1.0) - r_xz * r_xz) * (F.lit(1.0) - r_yz * r_yz)
    return F.when(left > 0, F.try_divide(r_xy - r_xz * r_yz, F.sqrt(left)))


def pooled_m2(n_present, mean_present, var_present, n_total) -> Column:
    """Sum of squared deviations over ``n_total`` rows when the absent ones are zeros."""
    zeros = n_total - n_present
    return var_present * n_present + mean_present * mean_present * n_present * zeros / n_total
