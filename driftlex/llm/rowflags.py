"""Verdicts on few rows of a large table, carried out without shuffling the rest.

Verdicts go by a row's key, a 64-bit hash of its identifier and text, so rows
with a null or repeated identifier are judged by their texts. A bitmap of the
flagged keys, of at most ``MOST_BUCKETS`` times 4 KB whatever their number,
goes to all tasks; rows outside it are clear and stay where they are. Only the
flagged ones, and those that share a bit with one, are shuffled and compared
by key. A full bitmap costs a shuffle of all rows, never a wrong verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlex.llm.scratch import materialise

#: Bits of one bitmap of the built-in aggregate, and bitmaps at most (8 MB).
BUCKET_BITS, MOST_BUCKETS = 32_768, 2048
#: Bits for each flagged key.
BITS_PER_KEY = 16


def row_key(identifier: str = "doc_id", text: str = "text") -> Column:
    """Key of a row: equal for rows with equal identifiers and texts, null or not."""
    return F.xxhash64(F.col(identifier).isNull(), F.col(identifier).cast("string"), F.col(text).isNull(), F.col(text).cast("string"))


def surplus(rows: DataFrame, group: str, key: str = "key") -> DataFrame:
    """Flags ``(key, once)`` that leave one row in each group: the least key, and one row of that key."""
    least = rows.groupBy(group).agg(F.min(key).alias("least"), F.count("*").alias("m")).where("m > 1").drop("m")
    each = rows.join(least, group).groupBy(key, "least").agg(F.count("*").alias("n"))
    return each.where(f"`{key}` <> least or n > 1").select(F.col(key).alias("key"), (F.col(key) == F.col("least")).alias("once"))


def parted(rows: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is surely none of ``keys`` (``key``, stored), and those that may be: all of them and a few more."""
    n = keys.count()
    if not n:
        return rows, rows.where("false")
    buckets = max(1, min(MOST_BUCKETS, -(-n * BITS_PER_KEY // BUCKET_BITS)))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(buckets)), F.lit(buckets * BUCKET_BITS))
    at = keys.select(place(F.col("key")).alias("at"))
    bits = at.groupBy(F.expr(f"at div {BUCKET_BITS}").alias("__bucket")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET_BITS).alias("__bits"))
    bits = materialise(bits, "bitmap")
    marked = rows.withColumn("__at", place(F.col(key))).withColumn("__bucket", F.expr(f"__at div {BUCKET_BITS}"))
    marked = marked.join(F.broadcast(bits), "__bucket", "left")  # MOST_BUCKETS rows of 4 KB at most
    byte = F.conv(F.hex(F.substring("__bits", F.expr(f"cast((__at % {BUCKET_BITS}) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(__byte, cast(__at % 8 as int)) % 2 = 1"), F.lit(False))
    marked = marked.withColumn("__byte", byte).withColumn("__maybe", maybe).drop("__at", "__bucket", "__bits", "__byte")
    return marked.where(~F.col("__maybe")).drop("__maybe"), marked.where("__maybe").drop("__maybe")


def settle(rows: DataFrame, flags: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` without those of a flagged key, or with one of them where ``once`` is true. ``flags`` has a key once and is stored."""
    clear, maybe = parted(rows, flags, key)
    judged = maybe.join(flags.select(F.col("key").alias(key), "once"), key, "left")
    out = clear.unionByName(judged.where("once is null").select(clear.columns))
    if not flags.where("once").isEmpty():
        # in order, so that a task that is run again gives its rows as before
        alone = judged.where("once").dropDuplicates([key]).sortWithinPartitions(key)
        out = out.unionByName(alone.select(clear.columns))
    return out
