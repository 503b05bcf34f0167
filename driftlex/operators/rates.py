"""Counts and per-million rates over crawls and years."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER = 1_000_000


def counts_by(rows: DataFrame, period: str, word: str = "target") -> DataFrame:
    return rows.groupBy(period, word).agg(F.count("*").alias("hits"))


def pooled(*counts: DataFrame, keys: tuple[str, ...] = ("year", "target")) -> DataFrame:
    """Partial counts of several runs added up."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy(*keys).agg(F.sum("hits").alias("hits"))


def dense(counts: DataFrame, periods: DataFrame, words: DataFrame) -> DataFrame:
    """Every period with every word, 0 where nothing was counted. Both sides are dimension lists."""
    grid = periods.crossJoin(F.broadcast(words))
    keys = [*periods.columns, *words.columns]
    return grid.join(counts, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def with_rate(counts: DataFrame, tokens: DataFrame, period: str) -> DataFrame:
    """``rate_per_million``; 0 where a period has no tokens or none are known."""
    t = tokens.select(period, F.col("tokens").alias("__tokens"))
    rate = F.when(F.col("__tokens") > 0, F.col("hits") * PER / F.col("__tokens")).otherwise(0.0)
    return counts.join(F.broadcast(t), period, "left").withColumn("rate_per_million", F.coalesce(rate, F.lit(0.0))).drop("__tokens")


def missing_tokens(counts: DataFrame, tokens: DataFrame, period: str) -> DataFrame:
    """Periods that have counts but no token total."""
    return counts.select(period).distinct().join(tokens, period, "left_anti")


def peaks(rates: DataFrame, period: str = "year", word: str = "target") -> DataFrame:
    """Per word the period of the highest rate (the earliest of ties), that rate, and all hits."""
    best = F.max_by(F.col(period), F.struct(F.col("rate_per_million"), -F.col(period)))
    return rates.groupBy(word).agg(best.alias(f"peak_{period}"), F.max("rate_per_million").alias("peak_rate_per_million"), F.sum("hits").alias("total_hits"))


def percent_of_peak(rates: DataFrame, value: str = "rate_per_million", word: str = "target") -> DataFrame:
    top = F.max(value).over(Window.partitionBy(word))
    return rates.withColumn("pct_of_peak", F.when(top > 0, 100 * F.col(value) / top))


def percent_of_peak_with_interval(series: DataFrame, value: str = "smoothed_rate", low: str = "rate_low", high: str = "rate_high", word: str = "target") -> DataFrame:
    """A series and its bounds as percentages of the series' own peak; as they are where the peak is 0."""
    top = F.max(value).over(Window.partitionBy(word))
    out = series.withColumn("__top", top)
    for c in (value, low, high):
        out = out.withColumn(c, F.when(F.col("__top") > 0, 100 * F.col(c) / F.col("__top")).otherwise(F.col(c)))
    return out.drop("__top")


def nonzero(series: DataFrame, value: str = "smoothed_rate") -> DataFrame:
    """The points that a chart marks: those above 0."""
    return series.where(F.col(value) > 0)


def reconstructed_counts(rates: DataFrame, tokens: DataFrame, period: str = "year", value: str = "rate_per_million") -> DataFrame:
    """``k``: whole counts that a rate and a period's millions of tokens stand for."""
    t = tokens.select(period, F.col("tokens").alias("__tokens"))
    return rates.join(t, period).withColumn("k", F.bround(F.col(value) * (F.col("__tokens") / PER)).cast("long")).drop("__tokens")


def gated(peak_rows: DataFrame, words: list[str] | None = None, least: int = 30) -> DataFrame:
    """The listed words, or those with enough hits; by peak year and word, if the result is read in order."""
    some = peak_rows.where(F.col("target").isin(words)) if words else peak_rows.where(F.col("total_hits") >= least)
    return some.orderBy("peak_year", "target")


def records(rates: DataFrame) -> DataFrame:
    """Nested peak records: rates and shares of the peak by year as maps."""
    shares = percent_of_peak(rates)
    maps = shares.groupBy("target").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "rate_per_million")))).alias("rate_by_year"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "pct_of_peak")))).alias("pct_of_peak_by_year"),
    )
    return peaks(rates).join(maps, "target")


def smoothed(grid: DataFrame, order: str, width: int = 9, word: str = "target") -> DataFrame:
    """Centred moving rate over a dense grid with ``hits`` and ``tokens``: pooled hits per million pooled tokens."""
    w = Window.partitionBy(word).orderBy(order).rowsBetween(-(width // 2), width // 2)
    k, n = F.sum("hits").over(w), F.sum("tokens").over(w)
    return grid.withColumn("window_hits", k).withColumn("window_tokens", n).withColumn("smoothed_rate", F.when(F.col("window_tokens") > 0, F.col("window_hits") * PER / F.col("window_tokens")).otherwise(0.0))


def smoothed_counts(grid: DataFrame, order: str, width: int = 9, word: str = "target") -> DataFrame:
    """The raw mode: mean hits over the periods of the window."""
    w = Window.partitionBy(word).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return grid.withColumn("smoothed_hits", F.sum("hits").over(w) / F.count("*").over(w))


def score_histogram(rows: DataFrame, score: str = "sense_score", word: str = "target") -> DataFrame:
    """(word, bin, n): scores in ten-thousandths; rows without a number are left out."""
    return rows.where(F.col(score).isNotNull()).groupBy(word, F.bround(F.col(score) * 10000).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def filter_rates(histogram: DataFrame, thresholds: tuple[float, ...], word: str = "target") -> DataFrame:
    """Per word, and for ALL, the kept number and filtered share at each threshold."""
    kept = [F.sum(F.when(F.col("bin") >= round(t * 10000), F.col("n")).otherwise(0)).alias(f"kept_at_{t:g}") for t in thresholds]
    out = histogram.rollup(word).agg(F.sum("n").alias("occurrences"), *kept, F.grouping(word).alias("__all"))
    pct = [(100.0 * (F.col("occurrences") - F.col(f"`kept_at_{t:g}`")) / F.col("occurrences")).alias(f"pct_filtered_at_{t:g}") for t in thresholds]
    name = F.when(F.col("__all") == 1, "ALL").otherwise(F.col(word)).alias(word)
    return out.select(name, "occurrences", *[f"`kept_at_{t:g}`" for t in thresholds], *pct)


def poisson_interval(k: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact (Garwood) bounds of a Poisson mean, by Newton steps on its distribution function, kept between known ends."""
    tail = (1 - level) / 2
    k = np.asarray(k, float)

    def cdf(n, mean):
        """P(X <= n) for whole n >= 0: the regularised upper incomplete gamma function of n + 1."""
        return _gamma_q(n + 1, mean)

    def solve(n, want):
        lo, hi = np.zeros_like(k), np.maximum(20, 3 * k + 30)
        z, a = NormalDist().inv_cdf(1 - want), n + 1
        mean = np.clip(a * (1 - 1 / (9 * a) + z / (3 * np.sqrt(a))) ** 3, 1e-9, hi)  # by Wilson and Hilferty
        for step in range(80):
            over = cdf(n, mean) - want
            lo, hi = np.where(over > 0, mean, lo), np.where(over > 0, hi, mean)
            slope = np.exp(n * np.log(mean) - mean - _LGAMMA(a))
            with np.errstate(all="ignore"):
                new = mean + over / slope
            new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
            moved, mean = np.abs(new - mean), new
            # what rounding leaves of large counts is far below the tenth digit
            if not k.size or (moved <= (1e-14 if step < 12 else 1e-10) * mean).all():
                break
        return mean

    low = np.where(k > 0, solve(np.maximum(k - 1, 0), 1 - tail), 0.0)
    return low, solve(k, tail)


_LGAMMA = np.vectorize(__import__("math").lgamma, otypes=[float])


def _gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, by series below a + 1 and continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(x) - x - _LGAMMA(a))
    steps = 60 + int(12 * np.sqrt(a.max() if a.size else 1))
    term = total = 1 / a
    n = a.copy()
    for _ in range(steps):
        n = n + 1
        term = term * x / n
        total = total + term
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full_like(x, 1 / tiny), 1 / np.where(b == 0, tiny, b)
    h = d
    for i in range(1, steps):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
    with np.errstate(all="ignore"):
        return np.clip(np.where(x < a + 1, 1 - front * total, front * h), 0, 1)


def with_interval(df: DataFrame, hits: str = "window_hits", tokens: str = "window_tokens") -> DataFrame:
    """``rate_low`` and ``rate_high``: bounds of the rate per million."""

    @F.pandas_udf("low double, high double")
    def bounds(k: pd.Series) -> pd.DataFrame:
        low, high = poisson_interval(k.to_numpy())
        return pd.DataFrame({"low": low, "high": high})

    scale = F.when(F.col(tokens) > 0, PER / F.col(tokens))
    return df.withColumn("__b", bounds(F.col(hits).cast("double"))).withColumn("rate_low", F.col("__b.low") * scale).withColumn("rate_high", F.col("__b.high") * scale).drop("__b")


def cubic(df: DataFrame, x: str, y: str, word: str = "target", clip: bool = True) -> DataFrame:
    """``fitted``: least-squares cubic per word, cut at 0 if ``clip``. A word's series is a bounded group: one row per period."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", fitted double"

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        ok = g[y].notna()
        if ok.sum() < 4:
            return g.assign(fitted=None)
        c = np.polynomial.Polynomial.fit(g[x][ok].astype(float), g[y][ok].astype(float), 3)
        at = c(g[x].astype(float))
        return g.assign(fitted=np.maximum(at, 0) if clip else at)

    return df.groupBy(word).applyInPandas(fit, out)


def cohort(year: Column, edges: tuple[int, int] = (2017, 2021)) -> Column:
    """Peak-year band: up to the first edge, up to the second, later."""
    return F.when(year <= edges[0], f"<={edges[0]}").when(year <= edges[1], f"{edges[0] + 1}-{edges[1]}").otherwise(f">{edges[1]}")


def top_words(counts: DataFrame, n: int, word: str = "target") -> DataFrame:
    return counts.groupBy(word).agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), word).limit(n)


def log_ratio(rates: DataFrame, first: int, last: int) -> DataFrame:
    """log2 of the last over the first year's rate, for words with both."""
    r = F.col("rate_per_million")
    per = rates.groupBy("target").agg(F.max(F.when(F.col("year") == first, r)).alias("rate_first"), F.max(F.when(F.col("year") == last, r)).alias("rate_last"))
    return per.where("rate_first > 0 and rate_last > 0").withColumn("log2_ratio", F.log2(F.col("rate_last") / F.col("rate_first")))


def variation(rates: DataFrame, least_periods: int = 5, least_mean: float = 2e-5) -> DataFrame:
    """log2 of the highest over the lowest positive rate of words seen often enough."""
    per = rates.where("rate_per_million > 0").groupBy("target").agg(F.count("*").alias("periods"), F.avg("rate_per_million").alias("mean_rate"), F.log2(F.max("rate_per_million") / F.min("rate_per_million")).alias("variation"))
    return per.where((F.col("periods") >= least_periods) & (F.col("mean_rate") >= least_mean * PER))


#: Columns that a wide table may have.
MOST_COLUMNS = 10_000


def wide_columns(rows: DataFrame, name: str) -> list[str]:
    """The values of a column that become columns of a wide table, sorted. None is left out: too many are an error, and the long form is the way."""
    found = sorted(r[0] for r in rows.select(name).where(F.col(name).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect())
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} values of {name}: keep the table long")
    return found


def ranked_totals(counts: DataFrame, group: int = 20) -> DataFrame:
    """(word, n, rank, grp) of (model, word, n): totals over the models, the highest first and ties by word, in groups of ``group``."""
    total = counts.groupBy("word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))  # a row for each word of a vocabulary
    return total.withColumn("rank", rank).withColumn("grp", F.floor((F.col("rank") - 1) / group))
