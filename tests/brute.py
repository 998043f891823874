"""Slow, direct versions of the statistics, to compare with."""
import numpy as np


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def pearson(a, b):
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def spearman(a, b):
    return pearson(ranks(a), ranks(b))


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def anderson(samples):
    """k-sample midrank statistic with the published variance, sums written out."""
    k = len(samples)
    pool = np.concatenate(samples)
    n = len(pool)
    z = np.unique(pool)
    lj = np.array([(pool == v).sum() for v in z])
    bj = np.array([(pool < v).sum() for v in z]) + lj / 2
    a2 = 0.0
    for s in samples:
        m = np.array([(s < v).sum() + (s == v).sum() / 2 for v in z])
        a2 += (lj / n * (n * m - len(s) * bj) ** 2 / (bj * (n - bj) - n * lj / 4)).sum() / len(s)
    a2 *= (n - 1) / n
    hs = sum(1 / len(s) for s in samples)
    h = sum(1 / i for i in range(1, n))
    g = sum(1 / ((n - i) * j) for i in range(1, n - 1) for j in range(i + 1, n))
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * hs
    b = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * hs - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * hs + 4 * h
    d = (2 * h + 6) * k * k - 4 * h * k
    var = (a * n**3 + b * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3))
    return (a2 - (k - 1)) / np.sqrt(var)


def sqdist(a, b):
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)


def median_sq(x):
    return np.median(sqdist(x, x)[np.triu_indices(len(x), 1)])


def mmd2(x, y, bw):
    k = lambda a, b: np.exp(-sqdist(a, b) / (2 * bw)).mean()
    return k(x, x) + k(y, y) - 2 * k(x, y)


def agreement(a, b):
    i, j = np.triu_indices(len(a), 1)
    sa, sb = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
    ok = (sa != 0) & (sb != 0)
    return float((sa[ok] == sb[ok]).mean())
