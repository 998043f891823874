"""Collocations against plain counts."""
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.llm import phrases

SCHEMA = "doc_id bigint, lang string, text string"


def NO(lang):
    return "und" if lang is None else lang


def brute(rows, longest=5, threshold=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[NO(lang)] += len(w)
            for k in range(1, longest + 1):
                f.update((NO(lang), *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= threshold}
    gone = {(p[0], *p[i:j]) for p, a in cand.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * a >= 100 * f[(p[0], *p[i:j])]}
    out = []
    for p, a in cand.items():
        if p not in gone:
            lang, w = p[0], p[1:]
            score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    seen, rows = Counter(), []
    for lang, s, a, w, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            rows.append((lang, seen[lang], w.decode(), -a, l, r, n[lang], -s))
    return rows


def odd_rows():
    rng = np.random.default_rng(2)
    words = ["a", "b", "c", "dd", "É", "straße", "x\x0bq", "e-e", "\U0001f600", "İ"]
    texts = [(i, ["en", "de", None, "und"][i % 4], "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " \t ", ". ", "\n", ", "]) for _ in range(60))) for i in range(80)]
    texts += [(500 + i, "en", "One TWO three four five six.") for i in range(30)] * 2
    long = "to be or not to be " * 3000
    return texts + [(900, "en", None), (901, "en", ""), (902, "fr", " \t\n"), (None, "fr", long), (903, "fr", long), (904, "", "p q " * 40)]


@pytest.mark.parametrize("threshold,chunk", [(20, 1 << 22), (20, 300), (7, 300)])
def test_collocations(spark, monkeypatch, threshold, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "COUNT_BYTES", chunk * 8)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "phrase", "a", "k", "l", "r", "part", "piece", "bit", "most", "score"):
        df = df.withColumn(name, F.lit("x"))
    want = brute([(lang, text) for _, lang, text in rows], threshold=threshold, top=50)
    got = [tuple(r) for r in phrases.collocations(df, threshold=threshold, top=50).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_nothing_to_count(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "en", None), (2, None, "one")], SCHEMA)).collect() == []


@pytest.mark.parametrize("capacity,heavy", [(40, 5), (1, 5), (100_000, 50)])
def test_frequent_items_survive(capacity, heavy):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.repeat(np.arange(heavy), 100), rng.integers(1000, 90_000, 40_000)])
    rng.shuffle(values)
    own = phrases.Summary(capacity, 100)
    for part in np.array_split(values, 57):
        items, counts = np.unique(part.astype(np.uint32), return_counts=True)
        own.add(items, counts)
    left = own.survivors()
    assert set(range(heavy)) <= set(left.tolist()) and own.taken < 100
    if capacity > len(values) // 100:
        assert own.capacity == capacity


def test_capacity_above_mass_over_threshold_is_enough():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 50_000, 200_000).astype(np.uint32)
    own = phrases.Summary(200_000 // 100 + 1, 100)
    for part in np.array_split(values, 40):
        own.add(*np.unique(part, return_counts=True))
    own.merge()
    assert own.capacity == 2001 and len(own.items) <= 2001


def test_lists_come_back():
    low = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 500).astype(np.uint32))
    assert (np.cumsum(phrases.spread(phrases.squeezed(np.diff(low, prepend=np.uint32(0))), 500), dtype=np.uint32) == low).all()
