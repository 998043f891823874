"""License scans: MinHash bands over overlapping windows retrieve notices, shingle containment verifies them.

Notices are cut into pieces of at most ``PIECE`` shingles, sorted into classes by length; every class has windows of twice
its length at steps of its length, so a piece that occurs lies whole in some window, with a Jaccard likeness of more than a
quarter.  With ``BANDS`` one-row bands such a window is missed with probability 0.75 ** 48 = 1e-6.  Every shingle of every
notice holds a cover word, so windows without one share nothing with any notice and need no signature.  Only DataFrame
functions are used.
"""
from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from screenloom.llm.secrets import let
from screenloom.llm.spots import ANCHORS, normal
from screenloom.session import durable

SHINGLE = 5
LEAST = 0.8
BANDS = 48
PIECE = 16
# Opening sentences and notices of common licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def pieces(n: int) -> list[tuple[int, int]]:
    """First and last-plus-one shingle of each piece of a notice with ``n`` shingles."""
    if n <= PIECE:
        return [(0, n)]
    return [(a, a + PIECE) for a in [*range(0, n - PIECE, PIECE), n - PIECE]]


def length_class(n: int) -> int:
    """The power of two from ``n`` up."""
    return 1 << (n - 1).bit_length()


def cover_words(notices: list[tuple[str, str]], shingle: int = SHINGLE) -> list[str]:
    """Words of which every shingle of every notice holds one; rare words first."""
    common = {w for ws in ANCHORS.values() for w in ws.split()}
    open_ = {tuple(w[i : i + shingle]) for _, t in notices for w in [plain_words(t)] for i in range(len(w) - shingle + 1)}
    chosen: list[str] = []
    while open_:
        score = Counter(w for s in open_ for w in set(s))
        best = min(score, key=lambda w: (w in common or len(w) < 2, -score[w], w))
        chosen.append(best)
        open_ = {s for s in open_ if best not in s}
    return sorted(chosen)


def shingles(words: Column, shingle: int = SHINGLE) -> Column:
    """Hash of the words from each position on, in order."""
    last = F.size(words) - (shingle - 1)
    at = F.slice(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), F.lit(1), F.greatest(last, F.lit(0)))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, shingle), " ")))


def band_keys(kind: Column, items: Column, bands: int = BANDS) -> Column:
    """One key for each band: class, band number and the least of the items' hashes under that number."""
    least = lambda b: F.array_min(F.transform(items, lambda x: F.xxhash64(x, b)))
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.xxhash64(kind, b, least(b)))


def _notice_table(spark, notices) -> DataFrame:
    rows = [(i, name, plain_words(text)) for i, (name, text) in enumerate(notices)]
    if any(len(w) < SHINGLE for _, _, w in rows):
        raise ValueError(f"a notice needs {SHINGLE} words")
    table = spark.createDataFrame(rows, "notice int, license string, w array<string>")
    return table.select("notice", "license", shingles(F.col("w")).alias("s"))


def _notice_keys(spark, notices) -> DataFrame:
    cut = [
        (i, length_class(b - a), a, b - a)
        for i, (_, text) in enumerate(notices) for a, b in pieces(len(plain_words(text)) - SHINGLE + 1)
    ]
    table = spark.createDataFrame(cut, "notice int, kind int, a int, n int").join(_notice_table(spark, notices), "notice")
    items = F.slice("s", F.col("a") + 1, F.col("n"))
    return table.select("notice", F.explode(band_keys(F.col("kind"), items)).alias("key")).distinct()


def _window_keys(words: Column, signs: Column, cover: Column, kind: int) -> Column:
    """Band keys of the windows of one class that hold a cover word; ``cover`` lists the positions of such words."""
    width, span = 2 * kind, 2 * kind + SHINGLE - 1
    first = lambda p: F.greatest(F.floor((p - span) / kind) + 1, F.lit(0)).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(cover, lambda p: F.sequence(first(p), F.floor(p / kind).cast("int")))))
    windows = F.filter(F.transform(starts, lambda s: F.slice(signs, s * kind + 1, width)), lambda w: F.size(w) > 0)
    return F.array_distinct(F.flatten(F.transform(windows, lambda w: band_keys(F.lit(kind), w))))


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, n_licenses, licenses, containment`` for every row of ``docs``: which licenses have a notice in the text.

    A notice is found when at least ``least`` of its distinct five-word shingles occur in the text; words are runs of letters
    and digits in lower case.  ``licenses`` is sorted and comma-joined, ``containment`` the largest share among found notices,
    0 without any.  ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null and empty texts, and texts of
    fewer than five words, have none.  Null ids stay null; repeated rows are scanned each; an empty table gives no rows.
    """
    notices = NOTICES if notices is None else notices
    spark = docs.sparkSession
    kinds = sorted({length_class(b - a) for _, t in notices for a, b in pieces(len(plain_words(t)) - SHINGLE + 1)})
    cover = cover_words(notices)
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = plain.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), normal(F.col("text")).alias("t"))
    some = numbered.where(F.rlike("t", F.lit(r"(?<![^ ])(?:" + "|".join(cover) + r")(?![^ ])")))
    worded = some.select("k1", "k2", F.split("t", " ").alias("w"))
    at = F.transform("w", lambda w, i: F.when(w.isin(*cover), i))
    signed = worded.select("k1", "k2", "w", shingles(F.col("w")).alias("s"), F.filter(at, lambda i: i.isNotNull()).alias("c"))
    keys = F.concat(*[_window_keys(F.col("w"), F.col("s"), F.col("c"), k) for k in kinds])
    held = durable(signed.select("k1", "k2", F.array_distinct("s").alias("own"), keys.alias("keys")).dropDuplicates(["k1", "k2"]))

    # the notices are a parameter of bounded size, so their tables are broadcast
    retrieved = held.select("k1", "k2", F.explode("keys").alias("key")).join(F.broadcast(_notice_keys(spark, notices)), "key")
    candidates = retrieved.select("k1", "k2", "notice").distinct()
    exact = candidates.join(held.select("k1", "k2", "own"), ["k1", "k2"])
    known = _notice_table(spark, notices).select("notice", "license", F.array_distinct("s").alias("wanted"))
    exact = exact.join(F.broadcast(known), "notice")
    share = F.size(F.array_intersect("wanted", "own")) / F.size("wanted")
    found = exact.select("k1", "k2", "license", share.alias("share")).where(F.col("share") >= least)
    by_text = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("share").alias("containment"))
    out = numbered.select("doc_id", "k1", "k2").join(by_text, ["k1", "k2"], "left")
    return out.select(
        "doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )
