"""Quality by nearest neighbours among labelled latent-semantic vectors.

Terms are whole words and byte trigrams, hashed to a fixed number of dimensions, and words that repeat the one or the second
before; they are weighted by log counts and inverse document frequency over all documents.  A truncated decomposition of a bounded sample of labelled texts gives the latent space.  The
labelled vectors (a few thousand by a few dozen numbers, whatever the corpus) go to every task; each document meets all of
them in blocked matrix products and its nearest ones vote, weighted by similarity.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from screenloom.llm.labelled import fold, sample, texts_of
from screenloom.llm.wordhash import WordHasher, lowered, row_slices, spans

#: Hashed dimensions of words and of trigrams.
WORDS, TRIGRAMS = 4096, 4096
#: Labelled rows at most that the space is fitted on and that vote.
MOST_LABELLED = 4096
RANK = 48
NEIGHBOURS = 15
#: Votes weigh this power of the cosine.
SHARPNESS = 4
#: Documents in one block of products.
BLOCK = 512
#: Distances at which a repeated word is a term, and what such a term weighs against others.
REPEATS, REPEAT_WEIGHT = (1, 2), 4.0
TERMS = WORDS + TRIGRAMS + len(REPEATS)


def term_counts(texts):
    """(first row, counts as rows x TERMS) of consecutive blocks of an Arrow text array."""
    hasher = WordHasher()
    for at, raw, ends in row_slices(texts, BLOCK):
        n = len(ends) - 1
        starts, stops, rows = spans(raw, ends)
        words = hasher(lowered(raw), starts, stops)
        cells = [rows * TERMS + (words >> np.uint64(52)).astype(np.int64)]
        for i, gap in enumerate(REPEATS):
            same = (words[gap:] == words[:-gap]) & (rows[gap:] == rows[:-gap])
            cells.append(rows[gap:][same] * TERMS + WORDS + TRIGRAMS + i)
        if len(raw) > 2:
            b = raw.astype(np.uint32)
            grams = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
            row = np.repeat(np.arange(n), np.diff(ends))
            inside = row[:-2] == row[2:]
            cells.append(row[:-2][inside] * TERMS + WORDS + grams[inside].astype(np.int64))
        yield at, np.bincount(np.concatenate(cells), minlength=n * TERMS).reshape(n, TERMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log counts times ``idf``; a row without terms stays zero."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _unit(z: np.ndarray) -> np.ndarray:
    return (z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def _document_frequency(batches):
    import pyarrow as pa

    total, n = np.zeros(TERMS, dtype=np.int64), 0
    for batch in batches:
        for _, counts in term_counts(batch["text"]):
            total += (counts > 0).sum(axis=0)
            n += len(counts)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(held, -1).astype(np.int64)), pa.array(np.append(total[held], n))], names=["term", "docs"]
    )


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each hashed term, counted over all of ``docs``."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_document_frequency, "term bigint, docs bigint")
    rows = counted.groupBy("term").agg(F.sum("docs").alias("docs")).collect()  # at most TERMS + 1 rows
    held = {r["term"]: r["docs"] for r in rows}
    n = held.pop(-1, 0)
    df = np.zeros(TERMS)
    df[list(held)] = list(held.values())
    idf = np.log((1.0 + n) / (1.0 + df))
    idf[WORDS + TRIGRAMS :] *= REPEAT_WEIGHT
    return idf.astype(np.float32)


def _sparse_rows(batches):
    """Arrow task: the terms of each text and their counts, as packed numbers."""
    import pyarrow as pa

    for batch in batches:
        for at, counts in term_counts(batch["text"]):
            held = [np.flatnonzero(row) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(at, len(counts)),
                    batch["y"].slice(at, len(counts)),
                    pa.array([h.astype(np.uint16).tobytes() for h in held], pa.binary()),
                    pa.array([row[h].astype(np.int32).tobytes() for row, h in zip(counts, held)], pa.binary()),
                ],
                names=["doc_id", "y", "term", "n"],
            )


def truncated_basis(blocks, rank: int, seed: int = 7, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (terms x rank) of the rows that ``blocks()`` yields, and the rows in that basis.

    Randomised subspace iteration; no more than a block of rows is dense at a time."""
    rows = sum(len(b) for b in blocks())
    q = np.random.default_rng(seed).standard_normal((TERMS, min(rank + 8, rows, TERMS))).astype(np.float32)
    for _ in range(passes):
        q, _ = np.linalg.qr(sum(b.T @ (b @ q) for b in blocks()))
    y = np.concatenate([b @ q for b in blocks()])
    _, _, v = np.linalg.svd(y, full_matrices=False)
    return (q @ v[:rank].T).astype(np.float32), y @ v[:rank].T


@dataclass
class Model:
    """Everything a task needs; its size depends on the parameters only."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    prior: float


def fit(docs: DataFrame, labels: DataFrame, target: str, train, most: int = MOST_LABELLED, rank: int = RANK) -> Model:
    """Term weights over all of ``docs``, latent space and voters from at most ``most`` labelled rows."""
    idf = inverse_frequency(docs)
    chosen = texts_of(docs, sample(labels, target, train, most))
    packed = chosen.mapInArrow(_sparse_rows, "doc_id bigint, y double, term binary, n binary").toArrow()  # at most ``most`` ids
    packed = packed.sort_by([("doc_id", "ascending"), ("n", "ascending")]).slice(0, most)
    if not len(packed):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)

    def blocks():
        for at in range(0, len(packed), BLOCK):
            part = packed.slice(at, BLOCK)
            counts = np.zeros((len(part), TERMS), dtype=np.int32)
            for row, term, n in zip(counts, part["term"], part["n"]):
                row[np.frombuffer(term.as_buffer(), np.uint16)] = np.frombuffer(n.as_buffer(), np.int32)
            yield weighted(counts, idf)

    basis, vectors = truncated_basis(blocks, rank)
    y = packed["y"].to_numpy()
    return Model(idf, basis, _unit(vectors), y, float(y.mean()))


def vote(model: Model, z: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Weighted mean label of the ``k`` nearest voters of each unit row of ``z``; the prior where none is near."""
    if not len(model.y):
        return np.full(len(z), model.prior)
    cosine = z @ model.vectors.T
    k = min(k, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    return np.where(total > 1e-9, (weight * model.y[near]).sum(axis=1) / np.maximum(total, 1e-9), model.prior)


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, counts in term_counts(batch["text"]):
                z = _unit(weighted(counts, model.idf) @ model.basis)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select([c for c in batch.schema.names if c != "text"]).slice(at, len(counts)).columns,
                     pa.array(np.round(np.clip(vote(model, z), 0.0, 1.0), 6))],
                    names=[*(c for c in batch.schema.names if c != "text"), "score"],
                )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, from ``labels`` (``doc_id``, ``quality``).

    Only the text is scored.  Labels of ids whose fold is ``held`` are never learnt from.  An empty or null text has no
    vector and gets the share of good labels (white space has trigrams); without any label every score is 0.5.  A null ``doc_id``
    is not held out.  Repeated rows are scored each; an empty table gives no rows.  Scores are
    rounded to six places: sums in blocks differ in the last bits with a row's place in its block.
    """
    model = fit(docs, labels, "quality", fold(modulus) != held)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(modulus) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; whole rows pass through the task that scores them."""
    model = fit(docs, labels, "quality", fold(4) != 2)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    carried = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]).cast("string"))
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes))
    scored = carried.mapInArrow(_score(model), f"{schema}, score double")
    return scored.where(F.col("score") >= threshold).select(*names).toDF(*docs.columns)
