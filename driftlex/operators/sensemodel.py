"""A sense model: weighted logistic regression on hashed tokens of a context.

A context's features are the buckets that its tokens hash to. The fit is
Newton's method with a ridge; of each step the gradient and the Hessian are sums
over rows, added up in tasks and then by entry, so that what reaches the driver
depends on the number of buckets alone. Scores are plain columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlex.functions import text as T
from driftlex.operators import annotation
from driftlex.sources.shared import stored

BUCKETS = 256
#: Penalty of squared weights, for each unit of row weight.
RIDGE = 1e-3
STEPS, CLOSE = 30, 1e-9


def features(context: Column | str, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of a context's tokens, as they stand; empty for a null. A bucket is the head of the token's MD5."""
    tokens = F.regexp_extract_all(F.col(context) if isinstance(context, str) else context, F.lit(f"[^{T.WS}]+"), F.lit(0))
    bucket = lambda x: (F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("int") % buckets).cast("int")
    return F.coalesce(F.array_distinct(F.transform(tokens, bucket)), F.array().cast("array<int>"))


@dataclass
class SenseModel:
    """Bias and weight of each bucket."""

    bias: float
    weights: np.ndarray

    def margin(self, context: Column | str) -> Column:
        return self.margin_of(features(context, len(self.weights)))

    def margin_of(self, found: Column) -> Column:
        """The same of a context's buckets."""
        table = F.array(*[F.lit(float(w)) for w in self.weights])
        return F.aggregate(found, F.lit(self.bias), lambda a, b: a + F.element_at(table, b + 1))

    def probability(self, context: Column | str) -> Column:
        """How likely a context has the sense that was labelled 1."""
        return 1 / (1 + F.exp(-self.margin(context)))

    def score(self, context: Column | str) -> Column:
        """The same between -1 and 1, to four places."""
        return F.round(2 * self.probability(context) - 1, 4)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(-1, self.bias), *[(i, float(w)) for i, w in enumerate(self.weights)]]
        spark.createDataFrame(rows, "bucket int, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SenseModel:
        found = {r["bucket"]: r["weight"] for r in spark.read.parquet(path).collect()}  # a row for each bucket
        return cls(found.pop(-1), np.array([found[i] for i in range(len(found))]))


def sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient, Hessian, weight) of the log-likelihood at ``beta`` (bias last), over ``buckets, label, weight``."""
    d = len(beta)

    def run(batches):
        g, h, total, scale = np.zeros(d), np.zeros((d, d)), 0.0, 0.0
        for batch in batches:
            lists, y, w = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            scale = scale or float(np.abs(w).max(initial=0.0)) or 1.0
            for a in range(0, len(y), 4096):
                part = lists.slice(a, 4096)
                row, bucket = np.repeat(np.arange(len(part)), pa.compute.list_value_length(part).to_numpy()), part.flatten().to_numpy()
                p = 1 / (1 + np.exp(-np.clip(beta[-1] + np.bincount(row, beta[bucket], len(part)), -500, 500)))
                own = w[a : a + 4096]
                off = own * (y[a : a + 4096] - p)
                g += np.bincount(bucket, off[row], d)
                g[-1] += off.sum()
                # the gradient, exact as it is, decides where the steps end; the Hessian gives their direction, for which single precision does
                root = np.sqrt(own * p * (1 - p) / scale).astype(np.float32)
                x = np.zeros((len(part), d), np.float32)
                x[row, bucket] = root[row]
                x[:, -1] = root
                h += x.T @ x
                total += own.sum()
        upper = np.triu_indices(d)
        value = np.concatenate([g, h[upper] * (scale or 1.0), [total]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value)], names=["entry", "value"])

    added = rows.select("buckets", F.col("label").cast("double"), F.col("weight").cast("double")).mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
    value = np.zeros(d + d * (d + 1) // 2 + 1)
    value[added["entry"].to_numpy()] = added["value"].to_numpy()
    h = np.zeros((d, d))
    h[np.triu_indices(d)] = value[d:-1]
    return value[:d], h + np.triu(h, 1).T, float(value[-1])


def learnable(rows: DataFrame, context: str = "context", label: str = "label", buckets: int = BUCKETS) -> DataFrame:
    """(buckets, label) of the rows with a context and a label of 0 or 1; others teach nothing."""
    return rows.where(F.col(context).isNotNull() & F.col(label).isin(0, 1)).select(features(context, buckets).alias("buckets"), F.col(label).cast("int").alias("label"))


def train(rows: DataFrame, context: str = "context", label: str = "label", buckets: int = BUCKETS, ridge: float = RIDGE) -> SenseModel:
    """Fit on rows with a context and a label of 0 or 1; others teach nothing. A class's rows weigh inversely to their number.

    The buckets of the rows are stored, to be read once for each step. Without rows all weights are 0.
    """
    return fit(stored(learnable(rows, context, label, buckets)), buckets, ridge)


def fit(known: DataFrame, buckets: int = BUCKETS, ridge: float = RIDGE) -> SenseModel:
    """The same from (buckets, label), which is read once for each step."""
    weight = annotation.class_weights(known, "label").first()
    known = known.withColumn("weight", F.when(F.col("label") == 1, float(weight["weight_1"] or 0)).otherwise(float(weight["weight_0"])))
    beta = np.zeros(buckets + 1)
    keep = np.append(np.ones(buckets), 0.0)
    for _ in range(STEPS):
        g, h, total = sums(known, beta)
        if not total:
            break
        g -= ridge * total * keep * beta
        h += np.diag(ridge * total * keep + 1e-12 * total)
        move = np.linalg.solve(h, g)
        beta += move / max(1.0, np.abs(move).max() / 4)
        if np.abs(g).max() <= CLOSE * total:
            break
    return SenseModel(float(beta[-1]), beta[:-1])


def gradient(rows: DataFrame, model: SenseModel, context: str = "context", label: str = "label", ridge: float = RIDGE) -> DataFrame:
    """(bucket, n, n_1, slope): rows and labels 1 of each bucket, and the objective's slope for a unit of weight, zero at the fit."""
    return slopes(stored(learnable(rows, context, label, len(model.weights))), model, ridge)


def slopes(known: DataFrame, model: SenseModel, ridge: float = RIDGE) -> DataFrame:
    """The same from (buckets, label)."""
    known = known.withColumn("p", 1 / (1 + F.exp(-model.margin_of(F.col("buckets")))))
    weight = annotation.class_weights(known, "label").first()
    w = F.when(F.col("label") == 1, float(weight["weight_1"] or 0)).otherwise(float(weight["weight_0"]))
    known = known.withColumn("weight", w)
    total = known.agg(F.sum("weight")).first()[0] or 1.0
    each = known.select(F.explode("buckets").alias("bucket"), "label", "weight", "p").groupBy("bucket")
    table = F.array(*[F.lit(float(x)) for x in model.weights])
    slope = F.sum(F.col("weight") * (F.col("label") - F.col("p"))) / total - ridge * F.element_at(table, F.col("bucket") + 1)
    return each.agg(F.count("*").alias("n"), F.sum("label").alias("n_1"), slope.alias("slope"))
