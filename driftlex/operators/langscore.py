"""How likely a text is English: naive Bayes on character trigrams.

Characters are dealt to 64 classes: letters a to z of either case, what is no
letter, and 37 classes of all others by code point. Trigrams around a letter or
other character are counted in the texts of known language, English and not;
a trigram's weight is the log ratio of its shares. A text's evidence is the mean
weight of its trigrams, for up to ``MOST_EVIDENCE`` of them, with the log odds of
English texts. All that is learned is one number for each of 2^18 trigrams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlex.sources.shared import bounded_batches, worked_out

CLASSES = 64
GRAMS = CLASSES**3
SMOOTHING = 0.5
#: Trigrams of a text count as so many independent ones at most.
MOST_EVIDENCE = 40
#: Characters that are looked at at once.
CHUNK = 1 << 20


def _class_table() -> np.ndarray:
    c = np.arange(0x110000)
    small = np.where((c >= 65) & (c <= 90), c + 32, c)
    return np.where(c >= 128, 27 + c % 37, np.where((small >= 97) & (small <= 122), small - 96, 0)).astype(np.int32)


_CLASS = _class_table()


def classes(text: str) -> np.ndarray:
    """Class of each character: 0 for ASCII other than letters, 1 to 26 for letters, from 27 on for all else."""
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def grams(text: str) -> Iterator[np.ndarray]:
    """Numbers of the trigrams whose middle is no class 0, a part of the text at a time."""
    for a in range(0, max(1, len(text) - 2), CHUNK):
        c = classes(text[a : a + CHUNK + 2])
        if len(c) >= 3:
            yield ((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])[c[1:-1] > 0]


@dataclass
class EnglishModel:
    """Weight of each trigram (0 for one that was never seen), which were seen, and the log odds of English texts."""

    weights: np.ndarray
    seen: np.ndarray
    odds: float

    def score(self, text: str | None) -> float:
        """Probability of English; 0 for a text without a trigram that was seen, as for a null."""
        total, n = 0.0, 0
        for g in grams(text or ""):
            total += float(self.weights[g].sum())
            n += int(self.seen[g].sum())
        if not n:
            return 0.0
        x = total / n * min(n, MOST_EVIDENCE) + self.odds
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def save(self, spark: SparkSession, path: str) -> None:
        at = np.flatnonzero(self.seen)
        rows = [(int(i), float(w)) for i, w in zip(at, self.weights[at], strict=True)]
        spark.createDataFrame([(-1, self.odds), *rows], "gram int, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EnglishModel:
        weights, seen, odds = np.zeros(GRAMS), np.zeros(GRAMS, bool), 0.0
        for r in spark.read.parquet(path).collect():  # GRAMS + 1 rows at most
            if r["gram"] < 0:
                odds = r["weight"]
            else:
                weights[r["gram"]], seen[r["gram"]] = r["weight"], True
        return cls(weights, seen, odds)


def gram_counts(docs: DataFrame, english: Column, text: str = "text") -> DataFrame:
    """(gram, n_english, n_other): trigrams of the texts that ``english`` is true or false for, and under gram -1 the texts."""
    bounded_batches(docs.sparkSession)
    own = docs.select(english.cast("boolean").alias("english"), F.col(text).cast("string").alias("text")).where("english is not null and text is not null")

    def run(batches):
        for batch in batches:
            count = np.zeros((2, GRAMS), np.int64)
            texts = np.zeros(2, np.int64)
            found: tuple[list, list] = [], []

            def add(k, count=count, found=found):
                if found[k]:
                    count[k] += np.bincount(np.concatenate(found[k]), minlength=GRAMS)
                    found[k].clear()

            size = [0, 0]
            for flag, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = 0 if flag else 1
                texts[k] += 1
                for g in grams(value.as_py()):
                    found[k].append(g)
                    size[k] += len(g)
                    if size[k] >= CHUNK:
                        add(k)
                        size[k] = 0
            add(0)
            add(1)
            at = np.flatnonzero(count.any(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(texts[0], count[0, at])), pa.array(np.append(texts[1], count[1, at]))],
                names=["gram", "n_english", "n_other"],
            )

    counted = own.mapInArrow(run, "gram int, n_english long, n_other long")
    return counted.groupBy("gram").agg(F.sum("n_english").alias("n_english"), F.sum("n_other").alias("n_other"))


def train(docs: DataFrame, english: Column, text: str = "text") -> EnglishModel:
    """A model of all texts that ``english`` is true or false for; null ones teach nothing. Without both kinds all odds are even."""
    rows = gram_counts(docs, english, text).toArrow()  # GRAMS + 1 rows at most
    gram, *counts = (rows[k].to_numpy() for k in ("gram", "n_english", "n_other"))
    e, o = (np.maximum(1, c[gram < 0].sum()) for c in counts)
    n_e, n_o = (c[gram >= 0] for c in counts)
    gram = gram[gram >= 0]
    weights, seen = np.zeros(GRAMS), np.zeros(GRAMS, bool)
    seen[gram] = True
    weights[gram] = np.log((n_e + SMOOTHING) / (n_e.sum() + SMOOTHING * len(gram))) - np.log((n_o + SMOOTHING) / (n_o.sum() + SMOOTHING * len(gram)))
    return EnglishModel(weights, seen, math.log(e / o))


def with_score(rows: DataFrame, model: EnglishModel, text: str = "text", name: str = "lang_score") -> DataFrame:
    """``name`` beside each row: the text's probability of English, by one pass without a shuffle."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # GRAMS numbers

    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return worked_out(rows.withColumn(name, F.arrow_udf(score, "double")(F.col(text).cast("string"))), name)
