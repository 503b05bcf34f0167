"""Exact top-k search by inner product, with a uniform threshold in three phases.

Vectors become integers, packed in chunks that hold each block of components
by itself. Queries go out in slices of bounded size; each slice meets every
chunk where it lies, so neither vectors nor lists of all scores travel.

1. For a query, a chunk gathers the head of each block's score list, in single
   precision; only these few entries are resolved to whole scores, and the k
   best are reported. The k-th best of all reports is a score that is reached:
   the safe cutoff ``t``.
2. The cutoffs go out. A score of ``t`` or more needs a block whose part is
   ``t / blocks`` or more, so a chunk collects the entries with such a part. A
   collected entry stays if its known parts, with the share for each unknown
   one, could still make ``t``. All comparisons allow for rounding.
3. What stays is resolved exactly; a chunk reports its k best, and the k best
   of all reports are the answer.

Reports are k rows for a query and chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlex.llm.scratch import materialise

K, EVERY = 5, 50
CHUNK, QUERIES, BLOCKS = 4096, 512, 4
#: Bytes of query vectors that go out at once, through the driver.
SLICE_BYTES = 16 << 20
_PACKED = "n int, dims int, ids binary, uids binary, blocks array<binary>, n_queries int"
_EXACT, _LONG = 2**53, 2**63


def _pack(batches):
    """Chunks of vectors: ids, row numbers, and blocks of components as doubles, padded with zeros to one length."""
    for batch in batches:
        ids, uids, vectors = (batch.column(i) for i in range(3))
        for a in range(0, batch.num_rows, CHUNK):
            part = vectors.slice(a, CHUNK)
            size = np.diff(np.asarray(part.offsets))
            flat = np.asarray(part.flatten(), np.float64)
            dims = int(size.max()) if len(size) else 0
            m = np.zeros((len(part), dims))
            m[np.arange(dims) < size[:, None]] = np.floor(256 * flat)
            i, u = np.asarray(ids.slice(a, CHUNK), np.int64), np.asarray(uids.slice(a, CHUNK), np.int64)
            order = np.lexsort((u, i))  # by id: ties go to the smaller
            m, blocks = m[order], []
            for c in _cuts(dims):
                blocks.append(np.ascontiguousarray(m[:, c]).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"n": pa.array([len(part)], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": [i[order].tobytes()], "uids": [u[order].tobytes()], "blocks": pa.array([blocks], pa.list_(pa.binary())), "n_queries": pa.array([int((i % EVERY == 0).sum())], pa.int32())}
            )


def _cuts(dims: int) -> list[slice]:
    step = max(1, -(-dims // BLOCKS))
    return [slice(a, min(a + step, dims)) for a in range(0, dims, step)]


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row numbers, vectors) of a chunk."""
    n = row["n"]
    parts = [np.frombuffer(b, np.float64).reshape(n, -1) for b in row["blocks"]]
    m = np.hstack(parts) if parts else np.zeros((n, 0))
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64), m


def block_lists(q: np.ndarray, v: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Parts of the scores by component block (queries by vectors), and how far each query's may be off by rounding."""
    d = min(q.shape[1], v.shape[1])
    lists, off = [], np.zeros(len(q))
    for c in _cuts(d) or [slice(0, 0)]:
        a, b = q[:, c], v[:, c]
        single = a.size and b.size and max(np.abs(a).max(), np.abs(b).max()) < 1e12
        kind, eps = (np.float32, 1.2e-7) if single else (np.float64, 2.3e-16)
        lists.append(a.astype(kind) @ b.astype(kind).T)
        norm = np.sqrt((b.astype(np.float64) ** 2).sum(1).max(initial=0)) * np.sqrt((a**2).sum(1))
        off = np.maximum(off, eps * (a.shape[1] + 4) * norm)
    return lists, off


def heads(lists: list[np.ndarray], j: int, own: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: entries at the head of a block's list for query j, itself aside."""
    n = len(own)
    found = [np.argpartition(-np.where(own, -np.inf, x[j]), min(k, n - 1))[: k + 1] for x in lists]
    at = np.unique(np.concatenate(found))
    return at[~own[at]]


def collected(lists: list[np.ndarray], off: float, j: int, own: np.ndarray, cutoff: float) -> np.ndarray:
    """Phase 2: entries that may reach the cutoff, by their parts above its share."""
    share = cutoff / len(lists)
    sent = [x[j] >= share - off for x in lists]
    at = np.flatnonzero(np.logical_or.reduce(sent) & ~own)
    bound = sum(np.where(s[at], x[j][at].astype(np.float64) + off, share) for s, x in zip(sent, lists, strict=True))
    return at[bound >= cutoff - off - 1e-9 * abs(cutoff)] if np.isfinite(cutoff) else at


def resolved(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Phase 3: exact scores of a query with some vectors; beyond the range of doubles in Python's integers."""
    d = min(len(q), v.shape[1])
    q, v = q[:d], v[:, :d]
    if d and len(v) and float(np.abs(q).max()) * float(np.abs(v).max()) * d >= _EXACT:
        whole = np.frompyfunc(int, 1, 1)
        return whole(v).dot(whole(q))
    return v @ q


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by falling score, ties by rising id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[-k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _meet(k: int, shared, final: bool):
    """Reports of a chunk for each query of the slice: of phase 1, or with cutoffs of phases 2 and 3."""

    def run(batches):
        qi, qu, vectors, cutoffs = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, uids, v = _unpack(row)
                out = {name: [] for name in _REPORT.names}
                for a in range(0, len(qi), QUERIES):
                    q = vectors[a : a + QUERIES]
                    lists, off = block_lists(q, v)
                    for j in range(len(q)):
                        own = uids == qu[a + j]
                        at = collected(lists, off[j], j, own, cutoffs[a + j]) if final else heads(lists, j, own, k)
                        total = resolved(q[j], v[at])
                        pick = _best(total, ids[at], k)
                        out["query"].extend([int(qu[a + j])] * len(pick))
                        out["query_id"].extend([int(qi[a + j])] * len(pick))
                        out["vec_id"].extend(ids[at][pick].tolist())
                        out["uid"].extend(uids[at][pick].tolist())
                        out["score"].extend(max(-_LONG, min(_LONG - 1, int(x))) for x in total[pick])
                        out["looked_at"].extend([len(at)] * len(pick))
                yield pa.RecordBatch.from_pydict(out, schema=_REPORT)

    return run


_REPORT = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "uid", "score", "looked_at")])
_REPORT_SQL = ", ".join(f"{c} long" for c in _REPORT.names)


def _queries(slices: int, number: int):
    """Ids, row numbers and vectors of the queries of a slice in each chunk."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, uids, v = _unpack(r)
                at = np.flatnonzero((ids % EVERY == 0) & (uids % slices == number))
                if len(at):
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(at)], pa.int32()), "ids": [ids[at].tobytes()], "uids": [uids[at].tobytes()], "vectors": [v[at].tobytes()]})

    return run


def _slice(chunks: DataFrame, slices: int, number: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = chunks.mapInArrow(_queries(slices, number), "n int, ids binary, uids binary, vectors binary").toArrow().to_pylist()
    parts = [np.frombuffer(r["vectors"], np.float64).reshape(r["n"], -1) for r in rows]
    ids, uids = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) if rows else np.zeros(0, np.int64) for c in ("ids", "uids"))
    vectors = np.vstack([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts]) if parts else np.zeros((0, dims))
    return ids, uids, vectors


def top_k(vectors: DataFrame, k: int = K, looked_at: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``EVERY`` the k best other rows.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns, whatever their names, are ignored. A
    component x counts as floor(256 x); the score is the integer inner product, over the shorter of the two
    if lengths differ, and at the ends of a long beyond them; ties go to the smaller id. Rows with a null id,
    or with a null vector or a null or non-finite component, take no part. An empty vector scores 0 with all.
    Repeated rows are candidates, and queries, each by itself. Vectors of any length count whole. An empty
    table gives an empty result. ``looked_at`` adds how many entries of its chunk were resolved for a row.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where("vec_id is not null and embedding is not null").where(F.forall("embedding", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    own = good.select("vec_id", F.monotonically_increasing_id().alias("uid"), "embedding")
    chunks = materialise(own.mapInArrow(_pack, _PACKED), "vectors")
    queries, dims = chunks.agg(F.sum("n_queries"), F.max("dims")).first()
    slices = max(1, -(-(queries or 0) * 8 * max(1, dims or 0) // SLICE_BYTES))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = lambda reports: reports.withColumn("rank", F.row_number().over(best))
    out = None
    for number in range(slices):
        ids, uids, m = _slice(chunks, slices, number, dims or 0)
        shared = spark.sparkContext.broadcast((ids, uids, m, None))  # SLICE_BYTES or so
        first = ranked(chunks.mapInArrow(_meet(k, shared, False), _REPORT_SQL)).where(F.col("rank") == k)
        at = first.select("query", "score").toArrow()  # a number for each query of the slice
        shared.destroy()
        cutoff = dict(zip(at["query"].to_pylist(), at["score"].to_pylist(), strict=True))
        limits = np.array([cutoff.get(u, -np.inf) for u in uids.tolist()], np.float64)  # without k entries there is none
        sent = spark.sparkContext.broadcast((ids, uids, m, limits))
        found = ranked(chunks.mapInArrow(_meet(k, sent, True), _REPORT_SQL)).where(F.col("rank") <= k)
        found = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *["looked_at"] * looked_at)
        if slices > 1:
            found = materialise(found, "top")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e, row_number() over () as uid
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.uid as quid, q.vec_id as query_id, v.vec_id, v.uid, cast(list_dot_product(q.e, v.e) as bigint) as score
  from v q join v on q.uid <> v.uid where q.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by quid order by score desc, vec_id, uid) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {K}
"""
