"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate keeps its own rate, and L1 leaves most weights at zero, so what travels to the tasks is a short list of
(feature, weight) pairs, whatever the size of the corpus.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from screenloom.llm.labelled import fold, sample, texts_of
from screenloom.llm.wordhash import Q1, Q2, WordHasher, lowered, mix, row_slices, spans

#: Bits of a feature number.
BITS = 20
#: Labelled rows at most that the weights are fitted on.
MOST_LABELLED = 20_000
#: Learners that see a share of those rows each; their weights are averaged.
SHARDS = 1
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def features(texts):
    """(first row, row of each feature, feature) of consecutive slices: words, pairs of neighbours, pairs with one between.

    ASCII letters count in lower case and ASCII punctuation as space, for words only."""
    hasher = WordHasher()
    for at, data, ends in row_slices(texts):
        data = lowered(data)
        data = np.where(_PUNCTUATION[data], np.uint8(0x20), data)
        starts, stops, rows = spans(data, ends)
        words = hasher(data, starts, stops)
        row, item = [rows], [words]
        for gap, q in ((1, Q1), (2, Q2)):
            if len(words) > gap:
                same = rows[gap:] == rows[:-gap]
                row.append(rows[gap:][same])
                item.append(mix(words[:-gap] * np.uint64(q) + words[gap:])[same])
        yield at, len(ends) - 1, np.concatenate(row), (np.concatenate(item) >> np.uint64(64 - BITS)).astype(np.int64)


def _examples(batches):
    import pyarrow as pa

    for batch in batches:
        for at, n, row, item in features(batch["text"]):
            pairs = np.unique(row << BITS | item)
            cut = np.searchsorted(pairs >> BITS, np.arange(n + 1))
            items = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(at, n), batch["y"].slice(at, n), batch["shard"].slice(at, n), items],
                names=["doc_id", "y", "shard", "items"],
            )


def learn(examples: list[tuple[float, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, distinct features): dense weights and the intercept (which L1 leaves alone)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(z, n, l1):
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, at = examples[i]
            w, bias = weights(z[at], n[at], L1), float(weights(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[at] = old + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return weights(z, n, L1), float(weights(np.float64(bias_z), np.float64(bias_n), 0.0))


def _learner(table):
    import pyarrow as pa

    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    y, items = table["y"].to_numpy()[order], table["items"].combine_chunks()
    cuts, flat = items.offsets.to_numpy(), items.values.to_numpy()
    w, bias = learn([(float(v), flat[cuts[i] : cuts[i + 1]]) for i, v in zip(order, y)])
    held = np.flatnonzero(w)
    return pa.table({"feature": pa.array(np.append(held, -1)), "weight": pa.array(np.append(w[held], bias))})


def fit(docs: DataFrame, labels: DataFrame, target: str, train, most: int = MOST_LABELLED, shards: int = SHARDS) -> dict[int, float]:
    """Weights by feature number (-1: intercept), the mean of ``shards`` learners on at most ``most`` labelled rows in all."""
    chosen = texts_of(docs, sample(labels, target, train, most))
    dealt = chosen.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int"))
    examples = dealt.mapInArrow(_examples, "doc_id bigint, y double, shard int, items array<int>")
    parts = examples.groupBy("shard").applyInArrow(_learner, "feature bigint, weight double")
    summed = parts.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    rows = {r["feature"]: (r["weight"], r["n"]) for r in summed.collect()}  # only what L1 left, at most 2**BITS
    learners = rows[-1][1] if rows else 1
    return {k: w / learners for k, (w, _) in sorted(rows.items())}


def _score(weights: dict[int, float]):
    bias = weights.get(-1, 0.0)
    held = np.array([k for k in weights if k >= 0], dtype=np.int64)
    value = np.array([weights[int(k)] for k in held])

    def run(batches):
        import pyarrow as pa

        table = np.zeros(1 << BITS)
        table[held] = value
        for batch in batches:
            for at, n, row, item in features(batch["text"]):
                known = np.flatnonzero(table[item])
                pairs = np.unique(row[known] << BITS | item[known])
                total = np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=n)
                score = 1.0 / (1.0 + np.exp(-np.clip(total + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), pa.array(score)], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, from ``labels`` (``doc_id``, ``toxic``).

    Only the text is scored.  Labels of ids whose fold is ``held`` are never learnt from.  An empty, blank or null text gets
    the intercept's probability; without any label every score is 0.5.  A null ``doc_id`` is not held out.  Repeated rows
    are scored each; an empty table gives no rows.
    """
    weights = fit(docs, labels, "toxic", fold(modulus) != held)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(_score(weights), "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(modulus) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
