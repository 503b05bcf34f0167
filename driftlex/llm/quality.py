"""Quality scores: a naive Bayes support vector machine on n-gram indicators.

N-grams are of words (one and two), of word shapes (one to three: first and last
sign, capitals, length, whether the word before is the same) and of character
classes (three). Each is an indicator, scaled by the log ratio of its counts in
the two classes; texts are scaled to unit length. The linear model minimises the
hinge loss by dual coordinate descent, and a logistic function of its margin,
fitted on labelled texts that it hasn't seen, gives the score.

Fitting is numpy in one task, on a bounded sample of labelled rows. Scoring is
one pass over the table, without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.llm.npwords import SPACE, Words, mix, release_memory, text_chunks
from driftlex.llm.scratch import bounded_batches, materialise

#: Labelled texts that the model is fitted on, of each class. Of a longer one than LONGEST characters, a window of that length.
MOST_OF_CLASS, LONGEST = 2500, 20_000
#: Buckets of hashed n-grams; a bucket counts if so many texts of the sample hold it.
BUCKETS, LEAST_DF = 1 << 20, 3
#: Count added to each n-gram in each class; bound of a dual variable; passes, and the violation that ends them early.
SMOOTHING, COST, PASSES, ENOUGH = 1.0, 1.0, 40, 1e-3
LEAST_SCORE = 0.7
SCORED_BYTES = 1 << 20


def _classes() -> np.ndarray:
    """Small letters, capitals, digits and bytes beyond ASCII are one class each, white space too; other signs are themselves."""
    c = np.full(256, 3, np.int64)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    other = [b for b in range(128) if not chr(b).isalnum() and not SPACE[b]]
    c[other] = 5 + np.arange(len(other))
    c[SPACE] = 4
    return c


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
CAPITAL = CLASS == 1


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of the texts, with repeats."""
    words = Words(data, off, SPACE)
    h, a, b = words.hashes(), words.starts, words.ends
    row = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
    rows, buckets = [], []

    def put(r, value, kind):
        rows.append(r)
        buckets.append((mix(value + np.uint64(kind << 60)) & np.uint64(BUCKETS - 1)).astype(np.int64))

    step = np.uint64(0xD6E8FEB86659FD93)
    near = row[1:] == row[:-1]
    put(row, h, 1)
    put(row[1:][near], (h[:-1] * step + h[1:])[near], 2)
    capitals = np.append(0, np.cumsum(CAPITAL[data]))
    loud = capitals[b] - capitals[np.minimum(a + 1, b)] > 0
    again = np.append(False, near & (h[1:] == h[:-1]))[: len(h)]
    shape = ((CLASS[data[a]] * N_CLASSES + CLASS[data[b - 1]]) * 8 + np.minimum(7, np.log2(b - a + 1e-9) + 1).astype(np.int64)) * 4 + loud * 2 + again
    shape = mix(shape.astype(np.uint64)) if len(shape) else h
    put(row, shape, 3)
    put(row[1:][near], (shape[:-1] * step + shape[1:])[near], 4)
    third = row[2:] == row[:-2]
    put(row[2:][third], ((shape[:-2] * step + shape[1:-1]) * step + shape[2:])[third], 5)
    c = CLASS[data]
    byte_row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    three = ((c[:-2] * N_CLASSES) + c[1:-1]) * N_CLASSES + c[2:]
    # a run of one class says nothing new: the n-gram that repeats its predecessor is left out
    own = byte_row[2:] == byte_row[:-2]
    own[1:] &= three[1:] != three[:-1]
    put(byte_row[2:][own], three[own].astype(np.uint64), 6)
    return np.concatenate(rows), np.concatenate(buckets)


def indicators(data: np.ndarray, off: np.ndarray, number: np.ndarray | None = None, width: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each distinct n-gram of each text; columns by ``number``, where below zero left out."""
    row, column = ngrams(data, off)
    if number is not None:
        column = number[column]
        row, column = row[column >= 0], column[column >= 0]
    pair = np.unique(row * width + column)
    return pair // width, pair % width


class Model:
    """Columns of the buckets that count; of each the product of ratio and weight, and the squared ratio."""

    def __init__(self, number: np.ndarray, product: np.ndarray, square: np.ndarray, bias: float, slope: float, shift: float):
        self.number, self.product, self.square, self.bias, self.slope, self.shift = number, product, square, bias, slope, shift

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        row, column = indicators(data, off, self.number, max(1, len(self.product)))
        dot = np.bincount(row, self.product[column], n)
        norm = np.sqrt(np.bincount(row, self.square[column], n))
        return dot / np.maximum(norm, 1e-12) + self.bias

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, off) + self.shift, -30, 30)))

    def __getstate__(self):
        used = np.flatnonzero(self.number >= 0).astype(np.int32)
        return used, self.product.astype(np.float32), self.square.astype(np.float32), self.bias, self.slope, self.shift

    def __setstate__(self, state):
        used, product, square, *rest = state
        number = np.full(BUCKETS, -1, np.int32)
        number[used] = np.arange(len(used))
        self.__init__(number, product.astype(np.float64), square.astype(np.float64), *rest)


def ratios(cut: np.ndarray, column: np.ndarray, y: np.ndarray, width: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each column's share in class 1 to that in class 0, over texts in sparse rows."""
    row = np.repeat(np.arange(len(y)), np.diff(cut))
    share = []
    for k in (1, 0):
        count = smoothing + np.bincount(column[y[row] == k], minlength=width)
        share.append(count / count.sum())
    return np.log(share[0] / share[1])


def hinge_fit(cut: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, cost: np.ndarray, width: int, seed: int = 5) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y (w x + bias)), bias counted in w.

    One dual variable at a time, in a new random order in each pass: its best value with all others fixed, within
    0 and its cost. Rows of ``value`` lie in ``column`` between the bounds ``cut``; y is -1 or 1.
    """
    r = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(y))
    square = np.add.reduceat(np.append(value**2, 0.0), cut[:-1]) * (np.diff(cut) > 0) + 1.0
    for _ in range(PASSES):
        worst = 0.0
        for i in r.permutation(len(y)):
            at = slice(cut[i], cut[i + 1])
            c, x = column[at], value[at]
            slope = y[i] * (w[c] @ x + bias) - 1
            free = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost[i] else slope
            worst = max(worst, abs(free))
            if free:
                new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
                move = (new - alpha[i]) * y[i]
                w[c] += move * x
                bias += move
                alpha[i] = new
        if worst < ENOUGH:
            break
    return w, bias, alpha


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method; targets are drawn in by one text of each class, so that the slope stays finite."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (t - p)) - 1e-3 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(cut: np.ndarray, bucket: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
    """A model from texts as sparse rows of buckets, labels 0 or 1, and the rows that each text stands for."""
    number = np.full(BUCKETS, -1, np.int32)
    if not len(y) or not y.any() or y.all():
        return Model(number, np.zeros(0), np.zeros(0), 0.0, 1.0, 30.0 if len(y) and y.all() else -30.0 if len(y) else 0.0)
    held = np.zeros(len(y), bool)
    r = np.random.default_rng(seed)
    for k in (0, 1):  # every fourth text of each class is kept for the logistic function
        own = np.flatnonzero(y == k)
        held[r.permutation(own)[: len(own) // 4]] = True
    row = np.repeat(np.arange(len(y)), np.diff(cut))
    have = np.flatnonzero(np.bincount(bucket[~held[row]], minlength=BUCKETS) >= LEAST_DF)
    number[have] = np.arange(len(have))
    column = number[bucket]
    known = column >= 0
    row, column, width = row[known], column[known], len(have)
    cut = np.searchsorted(row, np.arange(len(y) + 1))
    train = np.flatnonzero(~held)
    part = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in train]) if len(train) else np.zeros(0, np.int64)
    part_cut = np.append(0, np.cumsum(np.diff(cut)[train]))
    ratio = ratios(part_cut, column[part], y[train], width)
    norm = np.sqrt(np.bincount(row, ratio[column] ** 2, len(y)))
    value = ratio[column] / np.maximum(norm[row], 1e-12)
    balance = len(train) / 2 / np.bincount(y[train].astype(int), minlength=2)
    w, bias, _ = hinge_fit(part_cut, column[part], value[part], 2.0 * y[train] - 1, COST * balance[y[train].astype(int)], width, seed)
    margin = np.bincount(row, value * w[column], len(y)) + bias
    own = np.flatnonzero(held) if held.any() and 0 < y[held].mean() < 1 else np.arange(len(y))
    slope, shift = _logistic(margin[own], y[own].astype(float), weight[own] / weight[own].mean())
    return Model(number, ratio * w, ratio**2, bias, slope, shift)


def held_out():
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """Fit on at most ``MOST_OF_CLASS`` labelled texts of each class, picked by a hash.

    Texts of any length can be picked; of one beyond ``LONGEST`` characters, a window at a place that its hash
    gives is learned from. Equal texts count once, and with conflicting labels as 1. Null ids, labels and texts
    teach nothing. With labels of one kind only, that kind is certain; without any, all texts score a half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("key", F.xxhash64("text"))
    known = materialise(texts.select("doc_id", "key").join(known, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")), "labelled")
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    unit = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))

    def pick(y: int) -> DataFrame:
        """By a share first, so that the limit meets little more than it keeps, whatever the number of tasks."""
        share = min(1.0, (1.5 * MOST_OF_CLASS + 50) / max(1, total.get(y, 0)))
        return known.where(F.col("y") == y).withColumn("unit", unit).where(F.col("unit") < share * (1 << 30)).orderBy("unit", "key").limit(MOST_OF_CLASS).drop("unit")

    picked = materialise(pick(1).union(pick(0)), "picked")
    place = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.greatest(F.length("text") - LONGEST + 1, F.lit(1)).cast("long")).cast("int")
    # twice MOST_OF_CLASS keys at most
    sample = texts.join(F.broadcast(picked), ["doc_id", "key"]).withColumn("text", F.substring("text", place + 1, F.lit(LONGEST))).dropDuplicates(["key"]).select("key", "y", "text")

    def run(batches):
        parts = []
        for batch in batches:
            key, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, off in text_chunks(batch.column(2), SCORED_BYTES):
                row, bucket = indicators(data, off)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                parts += [(key[a + i], y[a + i], bucket[cut[i] : cut[i + 1]].astype(np.int32)) for i in range(b - a)]
        parts.sort(key=lambda p: p[0])
        y = np.array([p[1] for p in parts], np.int64)
        cut = np.append(0, np.cumsum([len(p[2]) for p in parts])).astype(np.int64)
        weight = np.array([total[k] for k in y.tolist()], float) / np.maximum(1, np.bincount(y, minlength=2))[y]
        model = fit(cut, np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int32), y, weight, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        release_memory()

    bounded_batches(docs.sparkSession)
    # the bounded sample meets in one task, whose memory is an executor's and not the driver's
    fitted = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), seed)


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """``columns`` of docs with ``score`` in [0, 1], a row for each row.

    Texts are scored whole, of any length; null and empty ones by the bias alone. Repeated rows are scored each by
    itself; columns that aren't asked for are left out, whatever their names. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: a number for each bucket at most
    kept = [f for f in docs.schema.fields if f.name in columns]
    own = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text").cast("string").alias("__text"))

    def run(batches):
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, off in text_chunks(batch.column(len(kept)), SCORED_BYTES):
                out[a:b] = m.scores(data, off)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out)], names=[*[f.name for f in kept], "score"])
        release_memory()

    return own.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "score double").select(*columns, "score")


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
