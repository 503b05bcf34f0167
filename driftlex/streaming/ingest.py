"""Incremental ingestion: files that arrive are scanned once, and counts are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlex.operators.kwic import kwic
from driftlex.sources.shared import shared_folder


def arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_contexts(docs: DataFrame, targets: list[str], out: str, checkpoint: str, keep: tuple[str, ...] = ("doc_id", "dump"), k: int = 20):
    """Contexts of new documents, appended by crawl; runs over what there is and ends."""
    rows = kwic(docs, targets, k, keep)
    return rows.writeStream.format("parquet").partitionBy("dump").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table, oldest first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(p)]
    done = [int(n.removeprefix("version=")) for n, at in names if n.startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))]
    return sorted(done)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current_counts(spark: SparkSession, table: str, by: str = "dump") -> DataFrame:
    """(by, target, hits): the newest finished version of a table of running counts."""
    versions = _versions(spark, table)
    schema = f"`{by}` string, target string, hits long"
    return spark.read.schema(schema).parquet(f"{table}/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def add_batch(counts: DataFrame, batch: int, table: str, by: str = "dump") -> None:
    """Version ``batch`` of a table: that of the batch before it plus ``counts`` (by, target, hits).

    A batch that comes again gives its version again, from the one before it, so it changes nothing. The
    version before is kept for that; older ones go.
    """
    spark = counts.sparkSession
    own = counts.select(F.col(by).cast("string").alias(by), "target", F.col("hits").cast("long").alias("hits"))
    before = [v for v in _versions(spark, table) if v < batch]
    if before:
        own = own.unionByName(spark.read.schema(f"`{by}` string, target string, hits long").parquet(f"{table}/version={before[-1]}"))
    own.groupBy(by, "target").agg(F.sum("hits").alias("hits")).write.mode("overwrite").parquet(f"{table}/version={batch}")
    for old in before[:-1]:
        _drop(spark, f"{table}/version={old}")


def stream_counts(docs: DataFrame, targets: list[str], table: str, checkpoint: str, by: str = "dump"):
    """Running counts of targets by crawl, as a versioned table; runs over what there is and ends. No state stays with the driver."""

    def put(batch: DataFrame, number: int) -> None:
        counts = kwic(batch, targets, 0, (by,), context=False).groupBy(by, "target").agg(F.count("*").alias("hits"))
        add_batch(counts, number, table, by)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_until(rows: DataFrame, collected: DataFrame | None, score, keep, by: str, n: int, keys: tuple[str, ...], rounds: int = 10, seed: int = 0, ledger: str | None = None) -> DataFrame:
    """The collect, score and filter loop: rounds of top-ups until each group has n kept rows or nothing is left.

    ``score`` maps rows to scored rows, ``keep`` filters them. What was scored is never drawn again. Each round is
    a version of a table in the shared folder (``ledger``, or a new one) and the next one reads it from there, so
    plans don't grow; a loop that is started again with its ``ledger`` goes on behind its last finished round.
    """
    from driftlex.operators.sampling import top_up

    spark = rows.sparkSession
    folder = ledger or f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    empty = score(rows.limit(0))
    first = collected if collected is not None else empty

    def scored() -> DataFrame:
        done = _versions(spark, folder)
        return spark.read.schema(first.schema).parquet(*[f"{folder}/version={v}" for v in done]) if done else first.limit(0)

    done = _versions(spark, folder)
    if not done:
        first.write.mode("overwrite").parquet(f"{folder}/version=0")
        done = [0]
    for i in range(done[-1], rounds):
        have = scored()
        fresh = top_up(rows.join(have.select(*keys), list(keys), "left_anti"), keep(have), by, n, *keys, seed=seed + i)
        score(fresh).write.mode("overwrite").parquet(f"{folder}/version={i + 1}")
        if spark.read.schema(first.schema).parquet(f"{folder}/version={i + 1}").isEmpty():
            break
    return keep(scored())
