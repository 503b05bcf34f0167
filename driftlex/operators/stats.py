"""Estimators over words and years: vintages, correlations, mixtures, bootstrap intervals.

Sums over rows are distributed. What is left for numpy are fits and replicates,
which are dealt over tasks (``mixtures`` has those of whole tables).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vintage(counts: DataFrame, peak_rows: DataFrame, *by: str) -> DataFrame:
    """Mean peak year weighted by counts, over words that have both."""
    j = counts.where("n > 0").join(F.broadcast(peak_rows.select("word", "peak_year")), "word")
    return j.groupBy(*by).agg((F.sum(F.col("n") * F.col("peak_year")) / F.sum("n")).alias("vintage"), F.sum("n").alias("hits"), F.count("*").alias("words"))


def vintage_lags(model_counts: DataFrame, corpus_counts: DataFrame, peak_rows: DataFrame, *by: str) -> DataFrame:
    """Each model's vintage, the corpus's over words with a peak, and the lag: how far the model's lies behind."""
    corpus = vintage(corpus_counts, peak_rows).select(F.col("vintage").alias("corpus_vintage"))
    models = vintage(model_counts, peak_rows, *by)
    return models.join(F.broadcast(corpus)).withColumn("lag", F.col("vintage") - F.col("corpus_vintage"))  # one row


def contributions(counts: DataFrame, peak_rows: DataFrame) -> DataFrame:
    """Each word's weight and weighted year. ``counts`` has a row for each word."""
    j = counts.where("n > 0").join(F.broadcast(peak_rows.select("word", "peak_year")), "word")
    total = j.agg(F.sum("n").alias("total"))
    return j.crossJoin(F.broadcast(total)).select("word", "n", "peak_year", (F.col("n") / F.col("total")).alias("weight"), (F.col("n") / F.col("total") * F.col("peak_year")).alias("contribution"))


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson's r; null for fewer than two rows or no variance."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by)
    ok = (F.count("*") >= 2) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return g.agg(F.count("*").alias("n"), F.when(ok, r).alias("r"))


def ranked(df: DataFrame, x: str, out: str, *by: str) -> DataFrame:
    """Average ranks, ties sharing theirs; counted over the distinct values of each group, within ranges and over them.

    A group's rows are never gathered: a value's rank joins back to them.
    """
    counts = df.groupBy(*by, x).agg(F.count("*").alias("__c"))
    dealt = counts.repartitionByRange(F.col(x)).withColumn("__part", F.spark_partition_id())
    own = dealt.groupBy(*by, "__part").agg(F.sum("__c").alias("__m"))
    ahead = own.withColumn("__ahead", F.coalesce(F.sum("__m").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__m")
    inner = F.coalesce(F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a.__part") == F.col("b.__part")]
    ranks = dealt.withColumn("__inner", inner).alias("a").join(ahead.alias("b"), same).select(*[F.col(f"a.{c}").alias(f"__{c}") for c in by], F.col(f"a.{x}").alias("__x"), (F.col("b.__ahead") + F.col("a.__inner") + (F.col("a.__c") + 1) / 2).alias(out))
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(x) == F.col("__x")]
    return df.join(ranks, match).drop("__x", *[f"__{c}" for c in by])


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(ranked(ranked(own, x, "__rx", *by), y, "__ry", *by), "__rx", "__ry", *by)


def linear_trend(df: DataFrame, x: str, y: str, *by: str, log: bool = False) -> DataFrame:
    """Slope and intercept of least squares; of logarithms of positive values if asked."""
    if log:
        df = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn(x, F.ln(x)).withColumn(y, F.ln(y))
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, h = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(abs(1 + num * d), 1e-300) * math.copysign(1, 1 + num * d)
        c = 1 + num / c if abs(c) > 1e-300 else 1e300
        h *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (h - 1)


def p_value(r: float | None, n: int) -> float | None:
    """Two-tailed p of a correlation; none for fewer than three rows or a perfect one."""
    if r is None or n < 3 or abs(r) >= 1:
        return None
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def with_p_value(df: DataFrame) -> DataFrame:
    """``p`` for rows of ``r`` and ``n``."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(None if pd.isna(a) else a, int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    return df.withColumn("p", p("r", "n"))


def smoothed_matrix(counts: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """(year, word, p): counts plus epsilon, over each year's sum; ``counts`` is dense."""
    c = F.col("hits") + epsilon
    return counts.withColumn("p", c / F.sum(c).over(Window.partitionBy("year")))


def em_weights(p: np.ndarray, q: np.ndarray, rounds: int = 2000, close: float = 1e-10) -> np.ndarray:
    """Mixture weights of the rows of p that come nearest to q in relative entropy."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        new = w * (p @ (q / np.maximum(w @ p, 1e-300)))
        new /= new.sum()
        done = np.abs(new - w).max() < close
        w = new
        if done:
            break
    return w


def l2_weights(p: np.ndarray, q: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Mixture weights by least squares on the simplex: accelerated projected gradient."""
    gram, lin = p @ p.T, p @ q
    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    w = z = np.full(len(p), 1 / len(p))
    t = 1.0
    for _ in range(rounds):
        new = _simplex(z - rate * (gram @ z - lin))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, t = new + (t - 1) / t2 * (new - w), t2
        if np.abs(new - w).max() < 1e-13:
            w = new
            break
        w = new
    return w


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    k = np.flatnonzero(u - c / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - c[k] / (k + 1), 0)


def relative_entropy(q: np.ndarray, model: np.ndarray) -> float:
    ok = q > 0
    return float((q[ok] * np.log(q[ok] / model[ok])).sum())


def poisson_bootstrap(spark, n: np.ndarray, value, replicates: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of ``value(counts)`` under Poisson draws of the counts. Replicates are dealt over tasks, each with its own seed."""

    def run(batches):
        for b in batches:
            got = []
            for i in b["id"]:
                x = np.random.default_rng([seed, int(i)]).poisson(n)
                got.append(value(x.astype(float)) if x.sum() else None)
            yield pd.DataFrame({"value": pd.Series(got, dtype="float64")})

    tail = (1 - level) / 2
    draws = spark.range(replicates).mapInPandas(run, "value double").where("value is not null")
    return draws.agg(F.avg("value").alias("mean"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count("*").alias("replicates"))


def response_bootstrap(counts: DataFrame, columns: list[str], value, replicates: int, seed: int = 42) -> DataFrame:
    """The same, resampling responses (rows of counts in ``columns``) with replacement.

    Equal rows are drawn together: a replicate's numbers of draws are multinomial over
    hash buckets, then over the distinct rows of each bucket. Only the buckets' sizes
    reach the driver.
    """
    buckets = 256
    c = [f"c{i}" for i in range(len(columns))]
    rows = counts.select(*[F.col(f"`{x}`").cast("long").alias(y) for x, y in zip(columns, c, strict=True)])
    distinct = rows.groupBy(*c).agg(F.count("*").alias("m")).withColumn("bucket", F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int"))
    size = np.zeros(buckets, np.int64)
    for r in distinct.groupBy("bucket").agg(F.sum("m").alias("m")).collect():
        size[r["bucket"]] = r["m"]
    total = int(size.sum())
    draws = np.random.default_rng(seed).multinomial(total, size / total if total else np.full(buckets, 1 / buckets), replicates)

    def sums(own):
        own = own.sort_values(c)
        b, m, x = int(own["bucket"].iloc[0]), own["m"].to_numpy(float), own[c].to_numpy(np.int64)
        r = np.random.default_rng([seed, b])
        part = max(1, (1 << 22) // len(m))
        got = np.vstack([r.multinomial(draws[i : i + part, b], m / m.sum()) @ x for i in range(0, replicates, part)])
        return pd.DataFrame(got, columns=c).assign(id=np.arange(replicates))

    def values(batches):
        for b in batches:
            yield pd.DataFrame({"value": pd.Series([value(x) if x.sum() else None for x in b[c].to_numpy(float)], dtype="float64")})

    drawn = distinct.groupBy("bucket").applyInPandas(sums, ", ".join(f"{x} long" for x in c) + ", id long")
    found = drawn.groupBy("id").agg(*[F.sum(x).alias(x) for x in c]).mapInPandas(values, "value double").where("value is not null")
    return found.agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("*").alias("replicates"))
