"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading
it back: a lost executor then costs a re-read, not a recomputation. A table
that nothing lazy reads any more is discarded, so that a long-lived driver
doesn't fill the folder; the rest goes when the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftlex.sources.shared import BATCH_BYTES as BATCH_BYTES
from driftlex.sources.shared import bounded_batches as bounded_batches

_made: dict[str, SparkSession] = {}

def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/driftlex-scratch"
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/driftlex/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._driftlex_path = path
    return out


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing can be deleted through it
        return


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no result still to be computed reads."""
    for t in tables:
        if path := getattr(t, "_driftlex_path", None):
            _delete(path)


@contextmanager
def scope(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Discard on leaving what was made inside, but for the tables put into the list."""
    before, kept = set(_made), list(keep)
    yield kept
    stay = {getattr(t, "_driftlex_path", None) for t in kept}
    for path in [p for p in _made if p not in before and p not in stay]:
        _delete(path)


def clean() -> None:
    """Delete the tables made so far. Results that still read them must have been stored before."""
    for path in list(_made):
        _delete(path)


atexit.register(clean)
