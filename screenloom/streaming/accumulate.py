"""Group means over a stream of chunks: partial sums per micro-batch, replay-safe and restartable."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from screenloom.functions.sizes import broadcast_if_small
from screenloom.operators.normalize import library_log1p

#: Rows of a micro-batch that one task compares.
ROWS_IN_TASK = 1_000_000


def event_stream(spark: SparkSession, folder: str, name: str = "events", per_trigger: int = 64) -> DataFrame:
    """File stream over one table; the schema is taken from the stored table, not inferred per file."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
        .option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    )


def chunk_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 8) -> DataFrame:
    """File stream over delivered chunks, at any depth below ``folder``."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
        .option("recursiveFileLookup", True).parquet(folder)
    )


def partial_sums(batch: DataFrame, keys: list[str], value: str) -> DataFrame:
    return batch.groupBy(*keys).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))


def refuse_bad_counts(batch: DataFrame) -> None:
    """Fail on a count that is negative or not finite, on a count without gene, and on a row without cell or construct."""
    c = F.col("cnt").cast("double")
    bad = (
        F.col("cell_id").isNull() | F.col("construct").isNull() | (F.col("cnt").isNotNull() & F.col("gene_idx").isNull())
        | (c < 0) | F.isnan(c) | (c == float("inf"))
    )
    n = batch.agg(F.count_if(bad)).first()[0]
    if n:
        raise ValueError(f"{n} bad count rows in a chunk")


def gene_sums(batch: DataFrame) -> DataFrame:
    """construct, gene_idx, s: each cell normalised by its own total, then summed."""
    stored = batch.where(F.col("gene_idx").isNotNull())
    return library_log1p(stored, keep=["construct"]).groupBy("construct", "gene_idx").agg(F.sum("v").alias("s"))


def cell_counts(batch: DataFrame) -> DataFrame:
    """construct, n: cells, those without any stored count included."""
    return batch.select("construct", "cell_id").distinct().groupBy("construct").agg(F.count(F.lit(1)).alias("n"))


def _row_hash(columns: list[str]):
    return F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(columns)])


def _refuse(status: DataFrame, chunk: str, wrong: dict[str, str]) -> None:
    """Fail on the first condition that any chunk meets; ``wrong`` maps what is said to the condition."""
    said = F.coalesce(*[F.when(F.expr(w), F.lit(t)) for t, w in wrong.items()])
    bad = status.select(chunk, said.alias("said")).where("said IS NOT NULL").limit(5).collect()
    if bad:
        raise ValueError(f"{bad[0]['said']}: {', '.join(str(x[0]) for x in bad if x['said'] == bad[0]['said'])}")


def accumulate(
    stream: DataFrame, state: str, checkpoint: str, outputs: dict[str, Callable[[DataFrame], DataFrame]],
    chunk: str | None = None, row: list[str] | None = None, check: Callable[[DataFrame], None] | None = None,
    manifest: DataFrame | None = None,
):
    """Write each micro-batch's ``outputs`` under their name and the batch number.

    A batch that runs again after a failure overwrites its own folders, so every batch counts once; the
    state is one small file set per batch, summed when read and folded by :func:`fold`.

    With ``chunk`` a ledger lists each consumed chunk with its number of rows and a digest of them, so the
    ledger grows with chunks, never with cells.  A later delivery of a consumed chunk is skipped if it holds the same
    rows, and refused if not, whenever it comes; ``row`` names a row inside a chunk, for a chunk that is delivered
    twice to one batch, and two different rows of one name are refused.  A chunk that comes again as it was is known by its
    sums alone; all other rows are dealt to tasks by the first column of ``row``, once a batch, so outputs that group by it
    move nothing more.

    Without ``manifest`` a chunk has to arrive whole in one micro-batch.  A manifest (the chunk and ``n_rows``) lets a
    chunk come in any number of files and batches: its rows wait under ``pending`` until all are there and are then
    consumed at once, a repeated delivery in parts included.  A chunk that the manifest does not name, or with
    more rows than it says, is refused."""
    spark = stream.sparkSession
    if chunk:
        kind = dict(stream.dtypes)[chunk]
        spark.createDataFrame([], f"{chunk} {kind}, n_rows bigint, digest decimal(38,0)").write.mode("overwrite").parquet(f"{state}/ledger/batch=-1")
    if manifest is not None:
        if not (chunk and row):
            raise ValueError("a manifest needs the names of chunks and of their rows")
        manifest.select(chunk, F.col("n_rows").cast("bigint").alias("n_want")).write.mode("overwrite").parquet(f"{state}/manifest")

    def known(own: SparkSession, number: int) -> DataFrame:
        out = own.read.option("basePath", f"{state}/ledger").parquet(f"{state}/ledger").where(F.col("batch") != number)
        return out.select(chunk, F.col("n_rows").alias("k_rows"), F.col("digest").alias("k_digest"))

    def by_chunk(batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The batch's rows with what waited before, each once, and the status of their chunks; without chunks that came again as they were."""
        own, names = batch.sparkSession, batch.columns
        if manifest is not None:
            earlier = [n for n in _numbers(own, f"{state}/pending", "batch=") if n < number]
            if earlier:
                batch = batch.unionByName(own.read.schema(batch.schema).parquet(f"{state}/pending/batch={max(earlier)}"))
        hashed = batch.withColumn("_hash", _row_hash(names))
        digest = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias("digest")
        came = hashed.groupBy(chunk).agg(F.count(F.lit(1)).alias("n_rows"), digest("_hash")).join(known(own, number), chunk, "left")
        came = came.withColumn("again", F.coalesce((F.col("n_rows") == F.col("k_rows")) & (F.col("digest") == F.col("k_digest")), F.lit(False))).persist()
        size, again = came.agg(F.sum(F.when(~F.col("again"), F.col("n_rows"))), F.count_if("again")).first()
        rows = hashed
        if again:
            rows = rows.join(broadcast_if_small(came.where("again").select(chunk)), chunk, "left_anti")
        if row:
            tasks = max(int(own.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // ROWS_IN_TASK))
            rows = rows.repartition(tasks, row[0]).persist()
            each = rows.groupBy(chunk, *row).agg(F.min("_hash").alias("a"), F.max("_hash").alias("b"), F.count(F.lit(1)).alias("n"))
            per = each.groupBy(chunk).agg(
                F.count(F.lit(1)).alias("n_rows"), digest("a"), F.sum("n").alias("n_came"), F.count_if(F.col("a") != F.col("b")).alias("n_mixed"))
            status = per.join(known(own, number), chunk, "left")
        else:
            rows = rows.persist()
            status = came.where("NOT again").drop("again").withColumns({"n_came": F.col("n_rows"), "n_mixed": F.lit(0)})
        status = status.join(own.read.parquet(f"{state}/manifest"), chunk, "left") if manifest is not None else status.withColumn("n_want", F.col("n_rows"))
        status = status.withColumn("whole", F.col("n_rows") == F.col("n_want")).persist()
        _refuse(status, chunk, {
            "rows of one name differ in chunks": "n_mixed > 0",
            "chunks that are not in the manifest, or with more rows than it says": "n_want IS NULL OR n_rows > n_want",
            "chunks came again with other rows": "whole AND k_rows IS NOT NULL AND (k_rows <> n_rows OR k_digest <> digest)",
        })
        if not status.where("n_came > n_rows").isEmpty():
            # rows of one name are equal here
            once = rows.distinct().persist()
            once.count()
            rows.unpersist()
            rows = once
        came.unpersist()
        return rows, status

    def write(batch: DataFrame, number: int) -> None:
        if check:
            check(batch)
        if not chunk:
            batch = batch.persist()
            for name, fn in outputs.items():
                fn(batch).write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")
            batch.unpersist()
            return
        rows, status = by_chunk(batch, number)
        fresh = status.where("whole AND k_rows IS NULL")
        taken = rows.join(broadcast_if_small(fresh.select(chunk)), chunk, "left_semi").select(*batch.columns)
        for name, fn in outputs.items():
            fn(taken).write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")
        if manifest is not None:
            waiting = rows.join(broadcast_if_small(status.where("NOT whole").select(chunk)), chunk, "left_semi").select(*batch.columns)
            waiting.write.mode("overwrite").parquet(f"{state}/pending/batch={number}")
        fresh.select(chunk, "n_rows", "digest").write.mode("overwrite").parquet(f"{state}/ledger/batch={number}")
        for df in (rows, status):
            df.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the sub-folders ``<prefix><number>`` that a finished write left."""
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(target)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and done(n))


def open_chunks(spark: SparkSession, state: str, chunk: str) -> DataFrame:
    """Chunks of which rows wait for others, with the number of rows that are there."""
    last = _numbers(spark, f"{state}/pending", "batch=")
    if not last:
        return spark.createDataFrame([], f"{chunk} string, n_rows bigint")
    return spark.read.parquet(f"{state}/pending/batch={last[-1]}").groupBy(chunk).agg(F.count(F.lit(1)).alias("n_rows"))


def snapshots(spark: SparkSession, state: str, name: str) -> list[tuple[int, int]]:
    """(number, last batch inside) of every complete snapshot of one output; the note of the last batch is written last."""
    folder = f"{state}/snapshots/{name}"
    out = []
    for n in _numbers(spark, f"{folder}/notes", "snapshot="):
        out.append((n, spark.read.parquet(f"{folder}/notes/snapshot={n}").first()["upto"]))
    return out


def fold(spark: SparkSession, state: str, name: str, keys: list[str]) -> int:
    """Fold one output into a new numbered snapshot, summed by ``keys``; gives its number, 0 while no batch has run.

    The snapshot before stays, with the batches after it, until the new one is complete, and readers take the newest complete
    one; a run that is killed in between changes nothing.  What neither of the last two needs is removed."""
    done = snapshots(spark, state, name)
    number, folder = (done[-1][0] if done else 0) + 1, f"{state}/snapshots/{name}"
    batches = _numbers(spark, f"{state}/{name}", "batch=")
    upto = max([*batches, *(u for _, u in done)], default=-1)
    if upto < 0:
        return 0
    rows = read_output(spark, state, name)
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "batch")]
    rows.groupBy(*keys).agg(*sums).write.mode("overwrite").parquet(f"{folder}/data/snapshot={number}")
    spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).write.mode("overwrite").parquet(f"{folder}/notes/snapshot={number}")
    if done:
        old = [f"{folder}/{part}/snapshot={n}" for n, _ in done[:-1] for part in ("notes", "data")]
        for path in old + [f"{state}/{name}/batch={b}" for b in batches if b <= done[-1][1]]:
            fs, target = _fs(spark, path)
            fs.delete(target, True)
    return number


def read_output(spark: SparkSession, state: str, name: str) -> DataFrame:
    """One output over all batches, with its batch number; batches inside the newest snapshot come summed under its last one."""
    done = snapshots(spark, state, name)
    number, upto = done[-1] if done else (0, -1)
    later = [f"{state}/{name}/batch={b}" for b in _numbers(spark, f"{state}/{name}", "batch=") if b > upto]
    rows = spark.read.option("basePath", f"{state}/{name}").parquet(*later) if later else None
    if not done:
        return rows
    folded = spark.read.parquet(f"{state}/snapshots/{name}/data/snapshot={number}").withColumn("batch", F.lit(upto).cast("int"))
    return folded.unionByName(rows) if rows is not None else folded


def read_state(spark: SparkSession, state: str, keys: list[str], name: str = "sums") -> DataFrame:
    """Total sum and count per key over all batches."""
    return read_output(spark, state, name).groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def finalize_checks(state: DataFrame, construct: str, control: str) -> DataFrame:
    """Control rows present, treated rows present, no zero count: check_name, n_bad, pass."""
    ctrl = F.count_if(F.col(construct) == control)
    trt = F.count_if(F.col(construct) != control)
    bad = state.agg(
        (ctrl == 0).cast("bigint").alias("no_control"), (trt == 0).cast("bigint").alias("no_treated"),
        F.count_if(F.col("n") <= 0).alias("zero_count"))
    names = ["no_control", "no_treated", "zero_count"]
    return bad.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_bad")) for n in names])).alias("c")).select(
        "c.check_name", "c.n_bad", (F.col("c.n_bad") == 0).alias("pass"))


def _refuse_unfinished(cells: DataFrame, construct: str, control: str) -> None:
    wrong = [x["check_name"] for x in finalize_checks(cells, construct, control).where(~F.col("pass")).collect()]
    if wrong:
        raise ValueError(f"cannot finalize: {wrong}")


def finalize(state: DataFrame, construct: str, control: str) -> DataFrame:
    """Construct mean minus control mean.  Fails when a check does: no control, no treated, zero count."""
    _refuse_unfinished(state, construct, control)
    base = state.where(F.col(construct) == control).agg((F.sum("s") / F.sum("n")).alias("m")).scalar()
    return state.where(F.col(construct) != control).select(
        construct, "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("s") / F.col("n") - base).alias("delta"))


def finalize_genes(spark: SparkSession, state: str, control: str) -> DataFrame:
    """construct, gene_idx, n, mean, delta for every gene a construct has a count of: its mean over all its
    cells, and minus the mean over all control cells.  Fails while rows of a chunk wait for others."""
    if waiting := open_chunks(spark, state, "chunk_id").limit(5).collect():
        raise ValueError(f"cannot finalize: chunks are not whole: {waiting}")
    cells = read_output(spark, state, "cells").groupBy("construct").agg(F.sum("n").alias("n"))
    _refuse_unfinished(cells, "construct", control)
    sums = read_output(spark, state, "sums").groupBy("construct", "gene_idx").agg(F.sum("s").alias("s"))
    means = sums.join(cells, "construct").select("construct", "gene_idx", "n", (F.col("s") / F.col("n")).alias("mean"))
    base = means.where(F.col("construct") == control).select("gene_idx", F.col("mean").alias("base"))
    return means.where(F.col("construct") != control).join(base, "gene_idx", "left").select(
        "construct", "gene_idx", "n", "mean", (F.col("mean") - F.coalesce("base", F.lit(0.0))).alias("delta"))
