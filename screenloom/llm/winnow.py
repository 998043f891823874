"""Benchmark decontamination by winnowing.

In every window of ``w`` consecutive k-grams the one with the least hash is kept, so two texts that share ``w + k - 1`` words
share a kept k-gram.  Kept k-grams of documents and benchmark meet in a join; around each hit the shared span is extended and
compared word by word.  Only DataFrame functions are used.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.llm.secrets import let
from screenloom.session import durable

#: Words in a window of an item, and in the k-grams that are hashed; GRAM + KEEP - 1 = SPAN.
SPAN, GRAM, KEEP = 10, 5, 6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the plain function will do for texts in ASCII."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1; nothing for n < 1."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), F.greatest(n, F.lit(0)))


def grams(words: Column, k: int) -> Column:
    """Hash of the k words from each position on."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda h, i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)])
    return let(hashed, lambda h: F.transform(_upto(F.size(h) - (k - 1)), lambda i: at(h, i)))


def winnowed(hashes: Column, keep: int) -> Column:
    """The least hash of each window of ``keep`` neighbours, each once."""
    if keep == 1:
        return F.array_distinct(hashes)
    least = lambda h: F.transform(
        _upto(F.size(h) - (keep - 1)), lambda i: F.least(*[F.get(h, i + j) for j in range(keep)])
    )
    return F.array_distinct(let(hashes, least))


def level(span: int) -> tuple[int, int]:
    """k and w for windows of ``span`` words: w + k - 1 = span; windows shorter than a full one are hashed whole."""
    return (GRAM, KEEP) if span == SPAN else (span, 1)


def kept_hashes(words: Column, spans: list[int]) -> Column:
    return F.concat(*[winnowed(grams(words, level(s)[0]), level(s)[1]) for s in spans])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, span, window``: every window of each item, as its words joined by spaces."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(SPAN))
    starts = items.withColumn("span", span).select("item_id", "w", "span", F.explode(_upto(F.size("w") - F.col("span") + 1)).alias("i"))
    return starts.select("item_id", "span", F.array_join(F.slice("w", F.col("i") + 1, F.col("span")), " ").alias("window")).distinct()


def _near(words: Column, matched: Column, span: int) -> Column:
    """Starts of the windows of ``span`` words around the positions whose k-gram is in ``matched``."""
    k, w = level(span)
    last = F.size(words) - span

    def around(h):
        hits = F.filter(_upto(F.size(h)), lambda i: F.array_contains(matched, F.get(h, i)))
        return F.transform(hits, lambda p: F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.least(p, last)))

    near = F.array_distinct(F.flatten(let(grams(words, k), around)))
    return F.when(last >= 0, near).otherwise(F.array().cast("array<int>"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    A window is ``SPAN`` consecutive words of an item, or the whole of a shorter one; a document word inside an occurrence of
    a window is hit.  ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are
    ignored.  Null, empty or wordless texts have no words and no windows; items without words or without id occur nowhere.
    Documents without id are judged by their text alone.  Repeated rows get the same answer each; no benchmark means no hit;
    an empty table gives no rows.
    """
    windows = durable(item_windows(benchmark.where(F.col("item_id").isNotNull())))
    spans = sorted((r["span"] for r in windows.select("span").distinct().collect()), reverse=True)  # at most SPAN numbers
    text = F.col("text").cast("string")
    id_ = F.col("doc_id")
    keyed = docs.select(id_, text.alias("text")).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")
    )
    none = F.array().cast("array<bigint>")
    worded = keyed.withColumn("w", words_of(F.col("text")))
    seen = durable(
        worded.select(
            "doc_id", "k1", "k2", F.size("w").cast("bigint").alias("n_words"),
            let(F.col("w"), lambda w: kept_hashes(w, spans)).alias("kept") if spans else none.alias("kept"),
        )
    )
    hit = _hits(seen, keyed, windows, spans)
    empty = F.sha2(F.lit(""), 256)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = seen.select("doc_id", "k1", "k2", "n_words").join(hit, ["k1", "k2"], "left")
    return out.select(
        "doc_id", "n_words", zero(F.col("n_hit")).alias("n_hit"), zero(F.col("n_items")).alias("n_items"),
        F.coalesce("items_sha256", empty).alias("items_sha256"), (zero(F.col("n_hit")) > 0).alias("contaminated"),
    )


def _hits(seen: DataFrame, keyed: DataFrame, windows: DataFrame, spans: list[int]) -> DataFrame:
    """``k1, k2, n_hit, n_items, items_sha256`` of the texts with an occurring window."""
    item_words = windows.select("span", F.split("window", " ").alias("w"))
    by_span = F.array().cast("array<bigint>")
    for s in spans:
        by_span = F.when(F.col("span") == s, kept_hashes(F.col("w"), [s])).otherwise(by_span)
    wanted = broadcast_if_small(item_words.select(F.explode(by_span).alias("h")).distinct())
    met = seen.select("k1", "k2", F.explode("kept").alias("h")).join(wanted, "h")
    matched = met.groupBy("k1", "k2").agg(F.collect_set("h").alias("matched"))

    texts = matched.join(keyed.select("k1", "k2", "text"), ["k1", "k2"]).withColumn("w", words_of(F.col("text")))
    starts = [_starts(span) for span in spans]
    every = F.concat(*starts) if starts else F.array().cast("array<struct<span:int,i:int>>")
    near = texts.select("k1", "k2", "w", every.alias("near"))
    cut = let(F.col("w"), lambda w: F.transform(F.col("near"), lambda x: F.struct(
        x["span"].alias("span"), x["i"].alias("i"), F.array_join(F.slice(w, x["i"] + 1, x["span"]), " ").alias("window"))))
    tried = near.select("k1", "k2", F.explode(cut).alias("x")).select("k1", "k2", "x.span", "x.i", "x.window").distinct()
    real = broadcast_if_small(windows.select("span", "window").distinct())
    found = durable(tried.join(real, ["span", "window"]))

    # union of the hit stretches, from left to right
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, x):
        end = x["i"] + x["span"]
        more = F.greatest(end - F.greatest(acc["upto"], x["i"]), F.lit(0))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + more).alias("n"))

    stretches = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("i", "span"))).alias("at"))
    covered = stretches.select("k1", "k2", F.aggregate("at", begin, step, lambda a: a["n"]).alias("n_hit"))
    pairs = found.select("k1", "k2", "span", "window").distinct().join(broadcast_if_small(windows), ["span", "window"])
    listed = pairs.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    listed = listed.select(
        "k1", "k2", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    return covered.join(listed, ["k1", "k2"])


def _starts(span: int) -> Column:
    place = let(F.col("w"), lambda w: _near(w, F.col("matched"), span))
    return F.transform(place, lambda i: F.struct(F.lit(span).alias("span"), i.cast("int").alias("i")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the texts in which a window of ``benchmark`` occurs; whole rows, whatever their other columns."""
    judged = contamination(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark)
    gone = judged.where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["_gone"], "left_anti")
