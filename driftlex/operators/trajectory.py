"""Shape statistics of a word's yearly series, as window functions and power sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roughness(series: DataFrame, value: str = "pct_of_peak", order: str = "year", word: str = "target") -> DataFrame:
    """Total variation, second-difference roughness, turning points and their z; null where a series is too short or flat."""
    w = Window.partitionBy(word).orderBy(order)
    d = series.withColumn("d1", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("d1n", F.lead("d1").over(w))
    d2 = F.col("d1n") - F.col("d1")
    agg = d.groupBy(word).agg(
        F.count("*").alias("n"),
        F.sum(F.abs("d1")).alias("moved"),
        (F.max(value) - F.min(value)).alias("span"),
        F.sqrt(F.avg(F.when(F.col("d1").isNotNull(), d2 * d2))).alias("bend"),
        F.stddev_samp(value).alias("sd"),
        F.sum(F.when(F.col("d1") * F.col("d1n") < 0, 1).otherwise(0)).alias("turns"),
    )
    ok = (F.col("n") >= 3) & (F.col("span") > 0)
    return agg.select(
        word,
        "n",
        F.when(ok, F.col("moved") / F.col("span")).alias("total_variation"),
        F.when(ok, F.col("bend") / F.col("sd")).alias("roughness"),
        F.when(ok, F.col("turns")).cast("long").alias("turns"),
        F.when(ok, (F.col("turns") - 2 * (F.col("n") - 2) / 3) / F.sqrt((16 * F.col("n") - 29) / 90)).alias("turns_z"),
    )


def quadratic(series: DataFrame, value: str = "pct_of_peak", order: str = "year", word: str = "target") -> DataFrame:
    """Adds ``fit`` of a least-squares parabola over 0..n-1 and ``r2`` per word; a flat series fits its mean."""
    w = Window.partitionBy(word)
    s = series.withColumn("x", (F.row_number().over(w.orderBy(order)) - 1).cast("double"))
    x, y = F.col("x"), F.col(value)
    n = F.count("*").over(w).cast("double")
    m = {k: F.sum(F.pow(x, F.lit(float(k)))).over(w) for k in (1, 2, 3, 4)}
    v = {k: F.sum(F.pow(x, F.lit(float(k))) * y).over(w) for k in (0, 1, 2)}

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    base = det(n, m[1], m[2], m[1], m[2], m[3], m[2], m[3], m[4])
    c0 = det(v[0], m[1], m[2], v[1], m[2], m[3], v[2], m[3], m[4]) / base
    c1 = det(n, v[0], m[2], m[1], v[1], m[3], m[2], v[2], m[4]) / base
    c2 = det(n, m[1], v[0], m[1], m[2], v[1], m[2], m[3], v[2]) / base
    mean = F.avg(value).over(w)
    s = s.withColumn("mean", mean).withColumn("fit", F.when(n >= 3, c0 + c1 * x + c2 * x * x).otherwise(mean))
    rest, total = F.sum(F.pow(y - F.col("fit"), 2)).over(w), F.sum(F.pow(y - F.col("mean"), 2)).over(w)
    return s.withColumn("r2", F.when(total > 0, 1 - rest / total)).drop("mean")


def noise(fitted: DataFrame, word: str = "target") -> DataFrame:
    """How far rates lie from their parabola, in Poisson standard errors; needs ``rate_per_million``, ``fit`` and ``tokens``."""
    millions = F.col("tokens") / 1e6
    lam = F.greatest(F.col("fit") * millions, F.lit(0.5))
    chi = F.pow(F.col("rate_per_million") - F.col("fit"), 2) / (lam / (millions * millions))
    out = fitted.groupBy(word).agg(F.count("*").alias("n"), F.sum(chi).alias("chi"))
    return out.select(word, F.when(F.col("n") > 3, F.sqrt(F.col("chi") / (F.col("n") - 3))).alias("noise_multiple"))


def standard_error(counts: DataFrame, word: str = "target") -> DataFrame:
    """Smallest relative standard error in percent: of the upper median of the non-zero yearly hits."""
    hits = F.array_sort(F.collect_list(F.when(F.col("hits") > 0, F.col("hits"))))
    out = counts.groupBy(word).agg(hits.alias("h"))
    middle = F.try_element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int"))
    return out.select(word, (100 / F.sqrt(middle)).alias("se_pct"))


def lowest(series: DataFrame, value: str = "pct_of_peak", word: str = "target") -> DataFrame:
    """Year of the lowest value, the first of ties, and that value."""
    return series.groupBy(word).agg(F.min_by("year", F.struct(F.col(value), F.col("year"))).alias("min_year"), F.min(value).alias("min_pct"))


def ephemeral(stats: DataFrame, filtered: DataFrame, least_hits: int = 80, most_min: float = 50.0, most_filtered: float = 80.0) -> DataFrame:
    """Targets with enough hits, a deep low and a tolerable filter rate; a word without a rate is kept."""
    rows = stats.join(filtered, "target", "left")
    return rows.where((F.col("total_hits") >= least_hits) & (F.col("min_pct") <= most_min) & F.coalesce(F.col("pct_filtered") <= most_filtered, F.lit(True)))


def aligned(series: DataFrame, peak_rows: DataFrame) -> DataFrame:
    """Years counted from each word's peak."""
    return series.join(peak_rows.select("target", "peak_year"), "target").withColumn("from_peak", F.col("year") - F.col("peak_year"))
