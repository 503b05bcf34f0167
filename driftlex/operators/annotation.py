"""Preparing labelled rows and judging classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlex.functions import text as T
from driftlex.operators import sampling


def valid_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose trimmed label is 0 or 1, as an integer."""
    t = F.btrim(F.col(label).cast("string"))
    return rows.where(t.isin("0", "1")).withColumn(label, t.cast("int"))


def usable_contexts(rows: DataFrame, exclude: DataFrame | None = None, low: int = 40, high: int = 600) -> DataFrame:
    """``clean`` contexts of a fit length that aren't among ``exclude(text)``, compared in lower case."""
    rows = rows.withColumn("clean", T.clean("target_context")).where(F.length("clean").between(low, high))
    if exclude is None:
        return rows
    # texts meet by a hash of 128 bits, not as they are
    keys = exclude.select(F.md5(F.lower(T.clean("text"))).alias("__key")).distinct()
    return rows.join(keys, F.md5(F.lower("clean")) == F.col("__key"), "left_anti")


def annotation_batch(rows: DataFrame, per_word: int, *keys: str, seed: int = 0) -> DataFrame:
    """Per group at most ``per_word`` contexts, each text once, from a sample of ``max(4 * per_word, 400)``."""
    rows = rows.withColumn("group_key", T.group_key("target"))
    pool = sampling.sample_by(rows, "group_key", max(4 * per_word, 400), *keys, seed=seed)
    order = [sampling.chance(*keys, seed=seed), *map(F.col, keys)]
    once = pool.withColumn("__r", F.row_number().over(Window.partitionBy("group_key", F.lower("clean")).orderBy(*order))).where("__r = 1")
    return once.withColumn("__r", F.row_number().over(Window.partitionBy("group_key").orderBy(*order))).where(F.col("__r") <= per_word).drop("__r")


def confusion(rows: DataFrame, truth: Column, predicted: Column, *groupings: str) -> DataFrame:
    """Counts and ratios overall and by each grouping column; undefined ratios are 0."""
    r = rows.withColumn("__t", truth.cast("int")).withColumn("__p", predicted.cast("int"))
    cell = lambda t, p: F.sum(((F.col("__t") == t) & (F.col("__p") == p)).cast("long"))
    cells = [cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")]
    if groupings:
        out = r.groupingSets([[], *[[g] for g in groupings]], *groupings).agg(*cells, F.grouping_id().alias("__g"))
        names = F.coalesce(*[F.when(F.col(g).isNotNull() & (F.col("__g") == 2 ** len(groupings) - 1 - 2 ** (len(groupings) - 1 - i)), F.concat(F.lit(f"{g}="), F.col(g).cast("string"))) for i, g in enumerate(groupings)], F.lit("all"))
        out = out.withColumn("slice", names)
    else:
        out = r.agg(*cells).withColumn("slice", F.lit("all"))
    c = F.col
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, q = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    out = out.withColumn("precision", p).withColumn("recall", q)
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0)))
    out = out.withColumn("accuracy", ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")))
    out = out.withColumn("fpr", ratio(c("fp"), c("fp") + c("tn"))).withColumn("fnr", ratio(c("fn"), c("fn") + c("tp")))
    return out.select("slice", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "fpr", "fnr")


def balance(rows: DataFrame, by: str, label: str = "label", most: int = 30) -> DataFrame:
    """Per group the numbers of each label, which label to add (-1: neither), and how often, if they are more than ``most`` apart."""
    n = rows.groupBy(by).agg(F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.sum((F.col(label) == 0).cast("long")).alias("n0"))
    need = F.abs(F.col("n1") - F.col("n0"))
    return n.withColumn("add_label", F.when(need > most, F.when(F.col("n1") < F.col("n0"), 1).otherwise(0)).otherwise(-1)).withColumn("add_n", F.when(need > most, need).otherwise(F.lit(0).cast("long")))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weights 1 and negatives over positives."""
    n = rows.agg(F.sum((F.col(label) == 1).cast("long")).alias("n_pos"), F.sum((F.col(label) == 0).cast("long")).alias("n_neg"))
    return n.select(F.lit(1.0).alias("weight_0"), (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("weight_1"))


def reference_examples(rows: DataFrame, by: str, n: int, *keys: str, label: str = "label", seed: int = 0) -> DataFrame:
    """At most n collected, not synthetic, examples of each class of each group."""
    own = rows.where(~F.coalesce(F.col("uri").contains("synthetic"), F.lit(False))).withColumn("__class", F.concat_ws("|", by, label))
    return sampling.sample_by(own, "__class", n, *keys, seed=seed).drop("__class")
