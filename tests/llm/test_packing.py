"""Packing against the tokenizer itself and against a plain best-two-fit, one sequence at a time."""
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from screenloom.llm import packing

FOLDER = os.environ.get("SCREENLOOM_TEST_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(pieces, capacity):
    """Number of sequences of best-two-fit over a list of lengths."""
    left, n = sorted(pieces), 0
    while left:
        own = []
        for x in reversed(left):
            if sum(own) + x <= capacity:
                own.append(x)
        rest = left[:]
        for x in own:
            rest.remove(x)
        least = min(own)
        gap = capacity - sum(own)
        if gap and len(own) > 1:
            pool = sorted([*rest, least])
            sums = [(a + b, a, b) for i, a in enumerate(pool) for b in pool[:i] if least < a + b <= gap + least]
            if sums:
                _, a, b = max(sums)
                own.remove(least)
                own += [a, b]
        for x in own:
            left.remove(x)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_two_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    pieces = [rng.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(rng.expovariate(1 / 6))) for _ in range(rng.randint(1, 250))]
    rows = packing.plan(Counter(pieces), capacity)
    filled, ranks = Counter(), Counter()
    for n, first, times, sequence, copies, offset in rows:
        assert ranks[n] == first
        ranks[n] += times * copies
        for s in range(sequence, sequence + times):
            assert filled[s] == offset
            filled[s] += n * copies
    assert ranks == Counter(pieces) and max(filled.values()) <= capacity
    assert len(filled) == brute(pieces, capacity)


def test_pair():
    left = Counter({2: 1, 3: 2, 5: 1, 9: 1})
    assert packing.best_pair(sorted(left), left, 4, 8) == (5, 3)
    assert packing.best_pair(sorted(left), left, 4, 6) == (3, 3)
    assert packing.best_pair(sorted(left), left, 1, 4) is None


def test_vocabulary_is_that_of_the_library():
    import tiktoken

    ranks, added = packing.vocabulary(PATH)
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    own = Tokenizer.from_file(PATH)
    signs = [chr(c) for c in range(1, 0x3000)] + ["\U0001f600", "<|endoftext|>", "  ", "'ll", "é"]
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(signs) + rng.choice(["", " ", "ab", "\n"]) for _ in range(200))
        assert codec.encode(text, allowed_special="all") == own.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    long = "word " * 9000
    odd = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, long), (-4, "twice"), (-4, "twice"), (None, "no id"), (None, None), (-5, "a <|endoftext|> b"), (-6, "x" * 30_000)], docs.schema
    )
    every = docs.union(odd)
    for name in ("piece", "length", "task", "place", "rank", "before", "n"):
        every = every.withColumn(name, F.lit("x"))
    out = packing.pack(every, PATH, public_tokenizers.PATTERN).collect()
    own = Tokenizer.from_file(PATH)
    want = Counter()
    for r in every.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    room = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 2048
    total = sum(r.length for r in out)
    assert len(room) <= -(-total // 2048) + 2
    assert packing.pack(docs.where("false"), PATH, public_tokenizers.PATTERN).collect() == []
