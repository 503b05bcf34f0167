"""Connected components by alternating large-star and small-star contractions.

Every step is a partial aggregation and an equi-join that adaptive execution
can split, so one vertex with very many edges doesn't land in one task.
Labels and links stay distributed; the driver sees a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.llm.scratch import discard, materialise


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return tuple(row)


#: Edges that are contracted together, and tasks that do so at least.
FOREST_EDGES, LEAST_TASKS = 1 << 20, 8


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, place of the least vertex of each one's component) of a list of edges."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(v))
    while True:
        p, q = label[x], label[y]
        low = np.minimum(p, q)
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return v, label
        label = new


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges ``(a, b)`` with the same components, from stored ones between longs.

    Edges are contracted task by task, some tasks' edges together: a task gives one edge for a vertex at most,
    whatever the number of its own.
    """

    def run(batches):
        own = [(np.asarray(t.column(0)), np.asarray(t.column(1))) for t in batches]
        if own:
            v, label = labels_of(*(np.concatenate([x[i] for x in own]) for i in (0, 1)))
            at = np.flatnonzero(label != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(v[label[at]]), pa.array(v[at])], names=["a", "b"])

    tasks = max(LEAST_TASKS, -(-edges.count() // FOREST_EDGES))
    return edges.select("a", "b").where("a is not null and b is not null").coalesce(tasks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges`` but the roots themselves; the root is the smallest vertex.

    Null ends and loops are ignored; repeated edges are harmless.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    e = materialise(e, "edges")
    stamp = _stamp(e)
    for _ in range(max_rounds):
        if not stamp[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
            .where("u < v")
            .distinct()
        )
        old, e = e, materialise(small, "edges")
        discard(old)
        now = _stamp(e)
        if now == stamp:
            break
        stamp = now
    else:
        raise RuntimeError("components did not settle")
    return e.select("v", F.col("u").alias("root"))
