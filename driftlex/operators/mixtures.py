"""Mixtures of years that come nearest to what each model says, for all models and replicates at once.

Input are long rows: for each fit and word its count, and the word's share in
each year. A fit of up to ``MOST_WORDS`` words is one group of rows, each a word
with its shares by year, and is iterated within its task; Spark deals fits over
tasks, and nothing of them comes to the driver. Larger fits are iterated
together, each step one aggregation over the words of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlex.operators.stats import em_weights, l2_weights
from driftlex.sources.shared import stored

#: Words of a fit that may meet in one task.
MOST_WORDS = 200_000
ROUNDS, CLOSE = 2000, 1e-10
#: Fits whose weights (a number for each year) may be broadcast; more are joined.
MOST_BROADCAST = 10_000


def packed(shares: DataFrame, counts: DataFrame) -> tuple[list[int], DataFrame]:
    """The years, and (fit, word, n, p): counts with the array of a word's shares by year, over words that have shares in each year.

    ``shares``: year, word, p. ``counts``: fit, word, n; fits without any count are left out.
    """
    years = sorted(r[0] for r in shares.select("year").distinct().collect())  # a row for each year
    by_year = shares.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("year", "p"))).alias("p")).where(F.size("p") == len(years))
    fits = counts.where("n > 0").select("fit").distinct()
    grid = fits.crossJoin(by_year.select("word", F.transform("p", lambda x: x["p"]).alias("p")))
    return years, grid.join(counts.select("fit", "word", "n"), ["fit", "word"], "left").fillna(0, ["n"])


def weights(years: list[int], cells: DataFrame, method: str = "em") -> DataFrame:
    """(fit, year, weight) from ``packed`` rows."""
    cells = stored(cells)
    largest = cells.groupBy("fit").count().agg(F.max("count")).first()[0] or 0
    if largest <= MOST_WORDS or method != "em":
        return _by_fit(years, cells, em_weights if method == "em" else l2_weights)
    return _together(years, cells)


def _normal(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p / p.sum(1, keepdims=True), n / n.sum()


def _by_fit(years: list[int], cells: DataFrame, fit: Callable) -> DataFrame:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("word")
        p, q = _normal(np.stack(own["p"].to_numpy()).T.astype(float), own["n"].to_numpy(float))
        return pd.DataFrame({"fit": own["fit"].iloc[0], "year": years, "weight": fit(p, q)})

    kind = cells.schema["fit"].dataType.simpleString()
    return cells.groupBy("fit").applyInPandas(run, f"fit {kind}, year int, weight double")


def _together(years: list[int], cells: DataFrame) -> DataFrame:
    """Steps of all fits, each an aggregation by fit; a fit that has settled is not read again."""
    k = len(years)
    each = lambda value: F.array(*[value(i) for i in range(k)])
    at = lambda a, i: F.element_at(a, i + 1)
    total = cells.groupBy("fit").agg(F.sum("n").alias("all"), each(lambda i: F.sum(at("p", i))).alias("sums"))
    rows = cells.join(total, "fit").select("fit", (F.col("n") / F.col("all")).alias("q"), each(lambda i: at("p", i) / at("sums", i)).alias("p")).where("q > 0")
    rows = stored(rows)
    state = stored(total.select("fit", each(lambda i: F.lit(1 / k)).alias("w"), F.lit(False).alias("settled")))
    few = state.count() <= MOST_BROADCAST
    dot = F.aggregate(F.zip_with("p", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    for _ in range(ROUNDS):
        moving = state.where("not settled").select("fit", "w")
        pull = rows.join(F.broadcast(moving) if few else moving, "fit").withColumn("r", F.col("q") / F.greatest(dot, F.lit(1e-300)))
        got = pull.groupBy("fit").agg(each(lambda i: F.sum(F.col("r") * at("p", i))).alias("pull"))
        new = state.join(got, "fit", "left").withColumn("v", F.zip_with("w", "pull", lambda a, b: a * b))
        new = new.withColumn("v", F.transform("v", lambda x: x / F.aggregate("v", F.lit(0.0), lambda a, y: a + y)))
        moved = F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b)))
        state = stored(new.select("fit", F.coalesce("v", "w").alias("w"), F.coalesce(moved < CLOSE, F.lit(True)).alias("settled")))
        if state.where("not settled").isEmpty():
            break
    years_of = F.array(*[F.lit(y) for y in years])
    return state.select("fit", F.explode(F.arrays_zip(years_of.alias("year"), F.col("w").alias("weight"))).alias("x")).select("fit", "x.year", "x.weight")


def mixture_of(years: list[int], cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """(fit, word, p_model, p_mix): each word's share of what was said, and that of the fitted mixture. Shares by year are normal over the words."""
    k = len(years)
    w = fitted.groupBy("fit").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "weight"))), lambda x: x["weight"]).alias("w"))
    sums = cells.groupBy("fit").agg(F.sum("n").alias("all"), F.array(*[F.sum(F.element_at("p", i + 1)) for i in range(k)]).alias("sums"))
    own = cells.join(sums, "fit").join(w, "fit")
    share = F.zip_with(F.zip_with("p", "sums", lambda a, b: a / b), "w", lambda a, b: a * b)
    return own.select("fit", "word", (F.col("n") / F.col("all")).alias("p_model"), F.aggregate(share, F.lit(0.0), lambda a, x: a + x).alias("p_mix"))


#: A word's share of the responses over the mixture's, from which it is flagged as over- or under-used.
OVER, UNDER = 3.0, 0.33


def word_fit(mixed: DataFrame) -> DataFrame:
    """(fit, word, p_model, p_mix, ratio, flag) of the words in use: flag 1 if over-used, -1 if under-used, else 0."""
    ratio = F.try_divide("p_model", "p_mix")
    flag = F.when(F.col("ratio").isNull() | (F.col("ratio") > OVER), 1).when(F.col("ratio") < UNDER, -1).otherwise(0)
    return mixed.where("p_model > 0").withColumn("ratio", ratio).withColumn("flag", flag)


def divergence(mixed: DataFrame) -> DataFrame:
    """(fit, divergence): relative entropy of what was said to the mixture, in nats."""
    term = F.when(F.col("p_model") > 0, F.col("p_model") * F.ln(F.col("p_model") / F.col("p_mix"))).otherwise(0.0)
    return mixed.groupBy("fit").agg(F.sum(term).alias("divergence"))


def uniform(fitted: DataFrame) -> DataFrame:
    """The same fits with equal weights: what a fit is held against."""
    return fitted.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("fit")))  # a row for each year


def vintages(fitted: DataFrame) -> DataFrame:
    """(fit, vintage): the mixture's mean year."""
    return fitted.groupBy("fit").agg(F.sum(F.col("weight") * F.col("year")).alias("vintage"))


def replicates(cells: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``packed`` rows for n Poisson draws of each fit's counts: (fit: struct of the fit and the replicate, word, n, p).

    A replicate's draw of a word is told by the seed, the fit, the replicate and the word.
    """

    def run(batches):
        for b in batches:
            keys = (b["fit"].astype(str) + "|" + b["word"].astype(str)).tolist()
            crcs = pd.util.hash_array(np.array(keys, object)) if keys else []
            drawn = [np.random.default_rng([seed, int(h), int(i)]).poisson(x) for h, i, x in zip(crcs, b["replicate"], b["n"], strict=True)]
            b["n"] = np.array(drawn, np.int64)
            yield b[["fit", "replicate", "word", "n", "p"]]

    kind = cells.schema["fit"].dataType.simpleString()
    each = cells.select("fit", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"), "word", F.col("n").cast("long").alias("n"), "p")
    drawn = each.mapInPandas(run, f"fit {kind}, replicate int, word string, n long, p array<double>")
    out = drawn.select(F.struct("fit", "replicate").alias("fit"), "word", "n", "p")
    some = out.groupBy("fit").agg(F.sum("n").alias("__all")).where("__all > 0").select("fit")
    return out.join(some, "fit", "left_semi")


def intervals(years: list[int], cells: DataFrame, n: int, method: str = "em", seed: int = 42, level: float = 0.95) -> DataFrame:
    """(fit, year, low, high, replicates) of the weights refitted to n draws; year null: of the mixture's vintage."""
    drawn = replicates(cells, n, seed).select(F.concat_ws("|", "fit.replicate", "fit.fit").alias("fit"), "word", "n", "p")
    refitted = stored(weights(years, drawn, method))
    values = refitted.select("fit", "year", F.col("weight").alias("value")).unionByName(vintages(refitted).select("fit", F.lit(None).cast("int").alias("year"), F.col("vintage").alias("value")))
    own = values.withColumn("fit", F.expr("substring(fit, instr(fit, '|') + 1)"))
    tail = (1 - level) / 2
    return own.groupBy("fit", "year").agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count("*").alias("replicates"))

