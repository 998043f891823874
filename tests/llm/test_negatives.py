"""Hard negatives against plain loops."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, positives=5, negatives=10):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, lab, q) in enumerate(ok):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w)), j, m) for m, (j, _, w) in enumerate(ok) if m != n)
        for s, j, _ in [t for t in scored if ok[t[2]][1] == lab][:positives]:
            near = [t for t in scored if ok[t[2]][1] != lab and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(i, j, r + 1, t[1], -s, -t[0]) for r, t in enumerate(near)]
    return sorted(out)


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(size=6).astype(np.float32).tolist()) for i in range(260)]
    rows += [(300, 1, [0.5] * 6), (301, 1, [0.5] * 6), (302, 2, [0.25] * 6), (303, 2, [0.25] * 6), (303, 2, [0.25] * 6)]  # ties, a repeated row
    rows += [(400, 1, [0.5] * 6), (400, 1, [0.5] * 6)]  # a repeated anchor
    rows += [(500, None, [0.5] * 6), (600, 1, None), (700, 1, [None] * 6), (800, 1, [math.nan] + [0.0] * 5), (900, 1, [math.inf] + [0.0] * 5)]
    return rows + [(None, 1, [0.5] * 6), (1000, 1, []), (1001, 1, [1.0, 2.0]), (1100, 77, [1.0] * 6)]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name in ("ANCHOR_BLOCK", "CANDIDATE_BLOCK", "SCORES"):
            monkeypatch.setattr(negatives, name, 40)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "vec", "a", "c", "is_anchor", "anchor_row", "wanted"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted(map(tuple, negatives.hard_negatives(df).collect()))
    assert got == brute(rows) and len(got) > 100


def test_nothing_to_mine(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)).collect() == []


@pytest.mark.parametrize("most", [5, 300, 10**6, 2**40, 2**61])
def test_products_are_exact(most):
    rng = np.random.default_rng(1)
    a, c = rng.integers(-most, most, (7, 13)), rng.integers(-most, most, (29, 13))
    want = a.astype(object) @ c.astype(object).T
    assert (negatives.products(a, c) == np.clip(want, -(1 << 63), (1 << 63) - 1).astype(np.int64)).all()
    width, fields, _ = negatives.layout(a, c)
    assert fields > 1 or width > 32


def test_huge_components():
    q = negatives.quantized([np.array([1e300, -0.001]), np.array([2.0])], 256)
    assert q.tolist() == [[int(1e300) * 256, -1], [512, 0]]
    assert negatives.products(q, q).tolist() == [[(1 << 63) - 1, (1 << 63) - 1], [(1 << 63) - 1, 512 * 512]]
