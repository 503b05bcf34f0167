"""A ledger of inputs: which files a job has finished, so that a second run doesn't read them.

A file is named by its path, size and time of change. Its entry is written after
the output of its batch is: what breaks off before that is done again, into the
same folder. Output and ledger are tables in folders, so nothing depends on the
driver that wrote them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, size long, modified timestamp, batch string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the files that a path, folder or pattern names; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """What the ledger holds; nothing before the first batch."""
    return spark.read.schema(ENTRY).parquet(ledger) if _exists(spark, f"{ledger}/_SUCCESS") else spark.createDataFrame([], ENTRY)


def unfinished(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """Inputs that have no entry as they are now; a file that has changed since has none."""
    return inputs(spark, path).join(entries(spark, ledger), ["path", "size", "modified"], "left_anti")


def advance(spark: SparkSession, path: str, out: str, ledger: str, read: Callable[[SparkSession, list[str]], DataFrame], most_files: int | None = None) -> list[str]:
    """Process the unfinished inputs: ``read(spark, files)`` gives their rows, which go to ``<out>/batch=<name>``. Returns the files that were read.

    A batch's name is told by its files, so that one that broke off is written over. At most ``most_files``, the
    first by path, are taken in one batch; the next call takes those after them.
    """
    new = unfinished(spark, path, ledger).orderBy("path")
    rows = (new.limit(most_files) if most_files else new).collect()  # names of files, which Spark lists on the driver as it is
    if not rows:
        return []
    files = [r["path"] for r in rows]
    name = hashlib.md5("\n".join(f"{r['path']}|{r['size']}|{r['modified']}" for r in rows).encode()).hexdigest()[:16]
    read(spark, files).write.mode("overwrite").parquet(f"{out}/batch={name}")
    done = spark.createDataFrame([(r["path"], r["size"], r["modified"], name) for r in rows], ENTRY)
    done.coalesce(1).write.mode("append").parquet(ledger)
    return files


def results(spark: SparkSession, out: str, ledger: str) -> DataFrame:
    """Rows of the finished batches, with their ``batch``; folders without an entry are left out."""
    names = [r[0] for r in entries(spark, ledger).select("batch").distinct().collect()]  # a name for each batch
    return spark.read.option("basePath", out).parquet(*[f"{out}/batch={n}" for n in names])
