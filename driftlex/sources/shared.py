"""Cutting lineage in the folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and Python: of long rows, ten thousand are more than a task should hold twice.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Set ``BATCH_BYTES`` for the session, where it hasn't set a bound of its own."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/driftlex-shared"
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back from there: a lost executor costs a re-read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_folders: list[tuple[SparkSession, str]] = []


def worked_out(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with some columns behind a one-row generator: filters on them stay above it.

    A filter that is pushed below a projection holds a copy of what the projection works out, for each use.
    """
    rest = [c for c in rows.columns if c not in names]
    out = rows.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(F.struct(*[F.col(f"`{n}`") for n in names]))))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns])


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the interpreter ends."""
    path = f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _folders:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing can be deleted through it
            return


atexit.register(_clean)
