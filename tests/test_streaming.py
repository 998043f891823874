"""Streamed group means: chunk boundaries, replay, restart and guards."""
import datetime as dt

import pytest

from screenloom.streaming import accumulate as A

SCHEMA = "ts timestamp, chunk_id int, cell_id int, construct string, value double"
DAY = dt.datetime(2024, 1, 1)
CELLS = [(DAY + dt.timedelta(hours=i), 0, i, "AAABBCCCCTTT"[i], float(i * i % 7)) for i in range(12)]


def chunks(spark, folder, cuts):
    edges = [0, *cuts, len(CELLS)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        rows = [(t, n, i, c, v) for t, _, i, c, v in CELLS[a:b]]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(s, root, **more):
    outputs = {"sums": lambda b: A.partial_sums(b, ["construct"], "value"), **more}
    A.accumulate(s, f"{root}/state", f"{root}/ckpt", outputs, "chunk_id", ["cell_id"]).awaitTermination()


def final(spark, root):
    out = A.finalize(A.read_state(spark, f"{root}/state", ["construct"]), "construct", "T")
    return {r["construct"]: (r["n"], round(r["delta"], 10)) for r in out.collect()}


def direct():
    of = lambda c: [v for *_, k, v in CELLS if k == c]
    base = sum(of("T")) / 3
    return {c: (len(of(c)), round(sum(of(c)) / len(of(c)) - base, 10)) for c in "ABC"}


@pytest.mark.parametrize("cuts", [[], [3, 7, 10], [1, 2, 11]])
def test_chunk_boundaries_do_not_matter(spark, tmp_path, cuts):
    chunks(spark, f"{tmp_path}/in", cuts)
    run(stream(spark, f"{tmp_path}/in"), tmp_path)
    assert final(spark, tmp_path) == direct()


@pytest.mark.parametrize("per_trigger", [1, 4])
def test_replayed_chunks_count_once(spark, tmp_path, per_trigger):
    """However late, and also when both deliveries reach one batch."""
    for _ in range(3):
        chunks(spark, f"{tmp_path}/in", [5])
    run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/in"), tmp_path)
    assert final(spark, tmp_path) == direct()
    for _ in range(2):  # years later, a new run on the same checkpoint
        chunks(spark, f"{tmp_path}/in", [5])
        run(stream(spark, f"{tmp_path}/in"), tmp_path)
    assert final(spark, tmp_path) == direct()
    ledger = spark.read.parquet(f"{tmp_path}/state/ledger")
    assert sorted(r["chunk_id"] for r in ledger.collect()) == [0, 1]


def test_restart_equals_uninterrupted(spark, tmp_path):
    for n, part in enumerate([CELLS[:4], CELLS[4:9], CELLS[9:]]):
        rows = [(t, n, i, c, v) for t, _, i, c, v in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream(spark, f"{tmp_path}/in"), tmp_path)
    assert final(spark, tmp_path) == direct()
    run(stream(spark, f"{tmp_path}/in"), tmp_path)
    assert final(spark, tmp_path) == direct()


def test_failed_batch_is_not_counted_twice(spark, tmp_path):
    """The batch fails after its sums are written; the restart runs it again into the same place."""
    chunks(spark, f"{tmp_path}/in", [6])

    def breaks(batch):
        raise RuntimeError("stop here")

    with pytest.raises(Exception, match="stop here"):
        run(stream(spark, f"{tmp_path}/in"), tmp_path, broken=breaks)
    run(stream(spark, f"{tmp_path}/in"), tmp_path)
    assert final(spark, tmp_path) == direct()


COUNTS = "chunk_id string, cell_id bigint, construct string, gene_idx int, cnt double"


def sparse(spark, root, rows, n=0):
    spark.createDataFrame(rows, COUNTS).coalesce(1).write.parquet(f"{root}/in/{n}")
    A.accumulate(
        A.chunk_stream(spark, f"{root}/in", COUNTS), f"{root}/state", f"{root}/ckpt", {"sums": A.gene_sums, "cells": A.cell_counts},
        "chunk_id", ["cell_id", "gene_idx"], A.refuse_bad_counts).awaitTermination()


def test_sparse_counts_divide_by_cells(spark, tmp_path):
    """Cells without an entry for a gene, or without any, count in the mean."""
    log = lambda x: __import__("math").log1p(1e4 * x)
    sparse(spark, tmp_path, [("a", 1, "X", 0, 2.0), ("a", 2, "X", None, None), ("a", 3, "T", 0, 1.0), ("a", 3, "T", 1, 3.0)])
    sparse(spark, tmp_path, [("b", 4, "X", 1, 5.0), ("b", 5, "T", None, None)], 1)
    out = {(r["construct"], r["gene_idx"]): (r["n"], r["mean"], r["delta"]) for r in A.finalize_genes(spark, f"{tmp_path}/state", "T").collect()}
    assert out[("X", 0)] == pytest.approx((3, log(1) / 3, log(1) / 3 - log(0.25) / 2))
    assert out[("X", 1)] == pytest.approx((3, log(1) / 3, log(1) / 3 - log(0.75) / 2))


@pytest.mark.parametrize("row", [("a", 1, "X", 0, -1.0), ("a", 1, "X", 0, float("nan")), ("a", 1, "X", None, 1.0), ("a", None, "X", 0, 1.0), ("a", 1, None, 0, 1.0), ("a", 1, "X", 0, float("inf"))])
def test_bad_counts_are_refused(spark, tmp_path, row):
    with pytest.raises(Exception, match="bad count rows"):
        sparse(spark, tmp_path, [("a", 7, "T", 0, 1.0), row])


def test_finalize_needs_controls_and_treated(spark):
    only = spark.createDataFrame([("A", 1.0, 2)], "construct string, s double, n bigint")
    with pytest.raises(ValueError, match="no_control"):
        A.finalize(only, "construct", "T")
    with pytest.raises(ValueError, match="no_treated"):
        A.finalize(only, "construct", "A")
    zero = spark.createDataFrame([("A", 1.0, 0), ("T", 1.0, 1)], "construct string, s double, n bigint")
    with pytest.raises(ValueError, match="zero_count"):
        A.finalize(zero, "construct", "T")


def two_files(spark, root, manifest, parts, fold_after=()):
    """Chunk ``c1`` in two files that reach two micro-batches."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, COUNTS).coalesce(1).write.parquet(f"{root}/in/{n}")
        A.accumulate(
            A.chunk_stream(spark, f"{root}/in", COUNTS, per_trigger=1), f"{root}/state", f"{root}/ckpt", {"sums": A.gene_sums, "cells": A.cell_counts},
            "chunk_id", ["cell_id", "gene_idx"], A.refuse_bad_counts, manifest).awaitTermination()
        if n in fold_after:
            A.fold(spark, f"{root}/state", "cells", ["construct"])


def cells_of(spark, root):
    return {r["construct"]: r["s"] for r in A.read_output(spark, f"{root}/state", "cells").groupBy("construct").agg({"n": "sum"}).toDF("construct", "s").collect()}


FIRST, SECOND = [("c1", 1, "X", 0, 2.0), ("c1", 2, "T", 0, 1.0)], [("c1", 3, "X", 1, 2.0), ("c1", 4, "T", 0, 5.0)]


def test_chunk_in_two_files_is_consumed_whole(spark, tmp_path):
    manifest = spark.createDataFrame([("c1", 4)], "chunk_id string, n_rows int")
    two_files(spark, tmp_path, manifest, [FIRST])
    assert cells_of(spark, tmp_path) == {} and [tuple(r) for r in A.open_chunks(spark, f"{tmp_path}/state", "chunk_id").collect()] == [("c1", 2)]
    with pytest.raises(ValueError, match="not whole"):
        A.finalize_genes(spark, f"{tmp_path}/state", "T")
    spark.createDataFrame(SECOND, COUNTS).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    run_more = lambda: A.accumulate(
        A.chunk_stream(spark, f"{tmp_path}/in", COUNTS, per_trigger=1), f"{tmp_path}/state", f"{tmp_path}/ckpt", {"sums": A.gene_sums, "cells": A.cell_counts},
        "chunk_id", ["cell_id", "gene_idx"], A.refuse_bad_counts, manifest).awaitTermination()
    run_more()
    assert cells_of(spark, tmp_path) == {"X": 2, "T": 2} and A.open_chunks(spark, f"{tmp_path}/state", "chunk_id").count() == 0
    # a repeat, cut in another way
    spark.createDataFrame([*FIRST, SECOND[0]], COUNTS).coalesce(1).write.parquet(f"{tmp_path}/in/again")
    spark.createDataFrame(SECOND[1:], COUNTS).coalesce(1).write.parquet(f"{tmp_path}/in/again2")
    run_more()
    assert cells_of(spark, tmp_path) == {"X": 2, "T": 2}


def test_second_arrival_with_other_rows_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="came again with other rows"):
        two_files(spark, tmp_path, None, [FIRST, SECOND])
    assert cells_of(spark, tmp_path) == {"X": 1, "T": 1}


@pytest.mark.parametrize("parts,said", [
    ([[*FIRST, *SECOND, ("c1", 5, "X", 0, 1.0)]], "more rows"), ([[("c2", 1, "X", 0, 1.0)]], "not in the manifest"), ([[*FIRST, ("c1", 1, "X", 0, 3.0)]], "rows of one name differ"),
])
def test_manifest_refuses(spark, tmp_path, parts, said):
    with pytest.raises(Exception, match=said):
        two_files(spark, tmp_path, spark.createDataFrame([("c1", 4)], "chunk_id string, n_rows int"), parts)


def test_snapshots(spark, tmp_path):
    """The previous snapshot is read until the next is complete; folded batches go once two snapshots hold them."""
    parts = [[(f"c{i}", i, "X" if i % 2 else "T", 0, 1.0)] for i in range(6)]
    two_files(spark, tmp_path, None, parts[:2], fold_after=(1,))
    state = f"{tmp_path}/state"
    assert A.snapshots(spark, state, "cells") == [(1, 1)] and cells_of(spark, tmp_path) == {"X": 1, "T": 1}
    # killed between the data of the next snapshot and its note
    spark.createDataFrame([("X", 99)], "construct string, n bigint").write.parquet(f"{state}/snapshots/cells/data/snapshot=2")
    assert cells_of(spark, tmp_path) == {"X": 1, "T": 1}
    for n, rows in enumerate(parts[2:]):
        spark.createDataFrame(rows, COUNTS).coalesce(1).write.parquet(f"{tmp_path}/in/more{n}")
    two_files(spark, tmp_path, None, [])
    A.accumulate(
        A.chunk_stream(spark, f"{tmp_path}/in", COUNTS, per_trigger=1), state, f"{tmp_path}/ckpt", {"sums": A.gene_sums, "cells": A.cell_counts},
        "chunk_id", ["cell_id", "gene_idx"], A.refuse_bad_counts).awaitTermination()
    assert cells_of(spark, tmp_path) == {"X": 3, "T": 3}
    assert A.fold(spark, state, "cells", ["construct"]) == 2 and A.fold(spark, state, "cells", ["construct"]) == 3
    assert cells_of(spark, tmp_path) == {"X": 3, "T": 3} and [n for n, _ in A.snapshots(spark, state, "cells")] == [2, 3]
    assert A._numbers(spark, f"{state}/cells", "batch=") == []


def test_rows_of_a_batch_are_dealt_once(spark, tmp_path):
    """Duplicates, totals and sums of a batch's rows come from one exchange by cell; a chunk that came again as it was does not reach it."""
    manifest = spark.createDataFrame([("c1", 4), ("c2", 2)], "chunk_id string, n_rows int")
    plans, deals = [], []

    def seen(batch):
        out = A.gene_sums(batch)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        deals.append(sorted({r["chunk_id"] for r in batch.select("chunk_id").collect()}))
        return out

    later = [("c2", 5, "X", 0, 2.0), ("c2", 6, "T", 0, 1.0)]
    for n, rows in enumerate([[*FIRST, *SECOND], [*FIRST, *SECOND, *later], [*FIRST, *SECOND]]):
        spark.createDataFrame(rows, COUNTS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        A.accumulate(
            A.chunk_stream(spark, f"{tmp_path}/in", COUNTS, per_trigger=1), f"{tmp_path}/state", f"{tmp_path}/ckpt", {"sums": seen, "cells": A.cell_counts},
            "chunk_id", ["cell_id", "gene_idx"], A.refuse_bad_counts, manifest).awaitTermination()
    assert deals == [["c1"], ["c2"], []] and cells_of(spark, tmp_path) == {"X": 3, "T": 3}
    # above the rows that the batch keeps
    assert not any("hashpartitioning(cell_id" in p.split("InMemoryTableScan")[0] for p in plans)
