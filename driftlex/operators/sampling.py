"""Seeded samples without replacement, by the order of a hash.

A hash order gives each row the same chance, needs no state, and picks the
same rows on every run. Small samples of a group use a bounded top-n
aggregation, so a hot group isn't gathered in one task before it is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlex.sources.shared import stored


def crawl_seed(base: int, index: Column, top_up: bool = False) -> Column:
    seed = (F.lit(base).cast("long") * 1000003 + index).bitwiseAND(0x7FFFFFFF)
    return seed.bitwiseXOR(0x5A5A5A5A) if top_up else seed


def chance(*keys: str | Column, seed: int = 0) -> Column:
    """The order of a sample: the first 16 digits of the MD5 of a row's keys and the seed, which any engine can tell."""
    own = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *own, F.lit(str(seed)))), 1, 16)


def sample(rows: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """n rows of all; ties of the hash by the keys."""
    return rows.orderBy(chance(*keys, seed=seed), *keys).limit(n)


def sample_by(rows: DataFrame, by: str, n: int, *keys: str, seed: int = 0, salts: int = 64) -> DataFrame:
    """n rows of each group. Groups are first cut within salted parts, then as a whole."""
    order = [F.col("__chance"), *map(F.col, keys)]
    r = rows.withColumn("__chance", chance(*keys, seed=seed)).withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    r = r.withColumn("__rank", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))).where(F.col("__rank") <= n)
    r = r.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rank") <= n)
    return r.drop("__chance", "__salt", "__rank")


def two_stage(rows: DataFrame, by: str, total: int, parts: int, *keys: str, seed: int = 0) -> DataFrame:
    """``total`` rows from ``parts`` sampled groups, about as many from each."""
    picked = sample(rows.select(by).distinct(), parts, by, seed=seed)
    inside = rows.join(F.broadcast(picked), by, "left_semi")
    return sample(sample_by(inside, by, -(-total // parts), *keys, seed=seed), total, *keys, seed=seed + 1)


#: Tokens beyond n and six of its deviations that a cutoff is to leave.
MARGIN = 20.0
#: Groups whose cutoffs (a name and a hash each) may be broadcast; more are joined.
MOST_BROADCAST = 100_000


def sample_tokens(rows: DataFrame, by: str, tokens: Column, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """(by, keys, at, word): n tokens of each group, uniform over occurrences; ``keys`` name a row, so the sample is the same in any partitioning.

    The n tokens of least hash. A group's number of tokens gives a cutoff that somewhat more than n hashes lie
    below; only those become rows. Where that many don't, the group is read again without a cutoff.
    """
    base = rows.select(by, *keys, tokens.alias("__tokens"))
    sizes = base.groupBy(by).agg(F.sum(F.size("__tokens").cast("long")).alias("__size")).where("__size > 0")
    share = (n + MARGIN + 6 * n**0.5) / F.col("__size")
    # as the first digits of a hash
    cut = F.when(share < 1, F.lpad(F.lower(F.hex((share * float(1 << 48)).cast("long"))), 12, "0")).otherwise("g")
    sizes = stored(sizes.select(F.col(by).alias("__by"), "__size", cut.alias("__cut")))
    few = sizes.count() <= MOST_BROADCAST

    def below(cutoffs: DataFrame) -> DataFrame:
        own = base.join(F.broadcast(cutoffs) if few else cutoffs, F.col(by).eqNullSafe(F.col("__by")))
        each = F.transform("__tokens", lambda w, i: F.struct(chance(*keys, i, seed=seed).alias("chance"), i.alias("at"), w.alias("word")))
        some = F.filter(each, lambda t: t["chance"] < F.col("__cut"))
        out = own.withColumn("__some", some).select(by, *keys, "__size", F.explode_outer("__some").alias("__t")).where("__t is not null")
        return out.select(by, *keys, "__size", "__t.*")

    drawn = stored(below(sizes))
    got = drawn.groupBy(F.col(by).alias("__got")).agg(F.count("*").alias("__n"))
    short = stored(sizes.join(got, F.col("__by").eqNullSafe(F.col("__got")), "left").where(F.coalesce("__n", F.lit(0)) < F.least(F.lit(n), F.col("__size"))).select("__by", "__size", F.lit("g").alias("__cut")))
    if not short.isEmpty():
        again = below(short)
        held = drawn.join(F.broadcast(short.select("__by")) if few else short.select("__by"), F.col(by).eqNullSafe(F.col("__by")), "left_anti")
        drawn = held.unionByName(again)
    order = Window.partitionBy(by).orderBy("chance", *keys, "at")  # about n rows of a group
    return drawn.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).select(by, *keys, "at", "word")


def fixed(rows: DataFrame, by: str, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """n rows of each group that has as many; smaller groups give none."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") >= n)
    return sample_by(rows.join(sizes.drop("__n"), by, "left_semi"), by, n, *keys, seed=seed)


#: Leading digits of the hash that make the ranges in which a split's cut is first looked for.
RANGE_DIGITS = 4


def stratified_split(rows: DataFrame, label: str, share: float, *keys: str, seed: int = 42) -> DataFrame:
    """``is_train``: the share of each label, by hash order; exact to a row in each label.

    The cut is found in counts by range of the hash; only the range that it falls in is ordered row by row.
    """
    r = rows.withColumn("__chance", chance(*keys, seed=seed))
    r = r.withColumn("__range", F.conv(F.substring("__chance", 1, RANGE_DIGITS), 16, 10).cast("int"))
    counts = r.groupBy(F.col(label).alias("__label"), "__range").agg(F.count("*").alias("__m"))
    along = Window.partitionBy("__label").orderBy("__range")  # 16 ** RANGE_DIGITS rows of a label at most
    cut = counts.withColumn("__upto", F.sum("__m").over(along)).withColumn("__n", F.sum("__m").over(Window.partitionBy("__label")))
    cut = cut.withColumn("__left", F.round(F.col("__n") * share) - F.col("__upto") + F.col("__m")).select("__label", F.col("__range").alias("__r"), "__m", "__left")
    r = r.join(cut, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__r")))
    some = (F.col("__left") > 0) & (F.col("__left") < F.col("__m"))
    order = Window.partitionBy("__label", "__range").orderBy("__chance", *keys)
    inside = r.where(some).withColumn("is_train", F.row_number().over(order) <= F.col("__left"))
    whole = r.where(~some).withColumn("is_train", F.col("__left") > 0)
    return whole.unionByName(inside).drop("__chance", "__range", "__label", "__r", "__m", "__left")


def top_up(rows: DataFrame, have: DataFrame, by: str, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """What groups with fewer than n collected rows still need, from rows not collected yet; groups are first cut to n in salted parts."""
    got = have.groupBy(by).agg(F.count("*").alias("__have"))
    fresh = rows.join(have.select(*keys).distinct(), list(keys), "left_anti").join(got, by, "left").withColumn("__need", n - F.coalesce("__have", F.lit(0))).where("__need > 0")
    few = sample_by(fresh, by, n, *keys, seed=seed ^ 0x5A5A5A5A)
    ranked = few.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(chance(*keys, seed=seed ^ 0x5A5A5A5A), *keys)))
    return ranked.where("__rank <= __need").drop("__have", "__need", "__rank")
