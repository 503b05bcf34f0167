"""Mixing sources to target weights by entropy balancing.

Of all document rates that give each source its target of words, those
nearest to 1 in relative entropy are exponential in a document's size,
``exp(lambda * size / mean)``, cut at ``MOST``. The convex dual is solved for
all sources at once by Newton steps, each one aggregation over a histogram of
(source, size); bisection bounds guard each step.

Rates become whole copies by dithered rounding with a common shift: a document
has a copy for each k up to ``MOST`` with ``k - rate - u <= shift``, u being a
hash of its identifier and text between 0 and 1. A source's taken words rise
with its shift one document at a time, so the shift is looked for in counts by
range, and a source ends within about half a document of its target.

Texts are read once, for their sizes. All state is a row for each source, in a
table; what a document gets follows from that row and the document alone, so
nothing is ranked, no hot source or size meets one task, and texts needn't be
shuffled to learn their copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlex.llm.rowflags import row_key
from driftlex.llm.scratch import discard, materialise

#: Weights of the sources in order of name, repeating; the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
STEPS, CLOSE = 60, 1e-7
#: The shift is found in so many rounds, each cutting what is left into so many ranges.
ROUNDS, CUTS = 3, 1024
#: Sources whose rows (about 60 bytes) may be broadcast; more are joined.
MOST_BROADCAST = 200_000
#: Equal rows are numbered in parts of so many.
PART = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last: within ranges of names, then over the ranges."""
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    parts = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id())
    parts = materialise(parts, "sources")
    before, offsets = 0, {}
    for r in parts.groupBy("__part").count().orderBy("__part").collect():  # a row for each range
        offsets[r["__part"]] = before
        before += r["count"]
    if not offsets:
        return parts.select("source", "source_size", F.lit(0).alias("number"))
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.select("source", "source_size", (inner + start[F.col("__part")]).alias("number"))


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``; sources by code point, null last.

    Each source gets its weight's share of all words, at most ``MOST`` times its own size; what is over
    goes to the others by weight until none is above. The share of one unit of weight, a number, rises with
    each round, so what is above stays so.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    rows = materialise(_ranked(sizes).select("source", "source_size", weight.alias("weight")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    most = MOST * F.col("source_size")
    share, capped = 0.0, -1
    while True:
        above = F.col("weight") * share > most
        r = rows.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, most)).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        if r["n"] == capped:
            return rows.select("source", "source_size", F.when(above, most.cast("double")).otherwise(F.col("weight") * share).alias("target"))
        capped = r["n"]
        share = (total - (r["given"] or 0)) / max(1, r["weights"] or 0)


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.when(tilt.isNull(), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(tilt * size / mean, F.lit(50.0)))))


def _of_source(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's row in ``state``, which is stored."""
    few = state.count() <= MOST_BROADCAST
    own = state.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def tilts(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, source_size, target, mean, tilt)``; a null tilt stands for the most copies of all documents.

    Newton's steps on the dual, one aggregation each; the driver sees the number of sources that are still open.
    """
    mean = histogram.where("size > 0").groupBy(F.col("source").alias("__m")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    none = F.lit(None).cast("double")
    free = (F.col("source_size") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-12))
    state = wanted.join(mean, F.col("source").eqNullSafe(F.col("__m")), "left").drop("__m")
    state = state.select("source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.when(free, 0.0).alias("tilt"), none.alias("lo"), none.alias("hi"), free.alias("open"))
    state = materialise(state, "tilts")
    for _ in range(STEPS):
        open_ = state.where("open").select("source", "mean", "tilt")
        if open_.isEmpty():
            break
        words, z, rate = F.col("size") * F.col("n"), F.col("size") / F.col("mean"), _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        cells = _of_source(histogram.where("size > 0"), open_)
        got = cells.groupBy(F.col("source").alias("__g")).agg(F.sum(words * rate).alias("sum"), F.sum(F.when(rate < MOST, words * rate * z).otherwise(0.0)).alias("slope"))
        j = state.join(got, F.col("open") & F.col("source").eqNullSafe(F.col("__g")), "left")
        tilt, off = F.col("tilt"), F.col("sum") - F.col("target")
        lo, hi = F.when(off <= 0, tilt).otherwise(F.col("lo")), F.when(off > 0, tilt).otherwise(F.col("hi"))
        both = lo.isNotNull() & hi.isNotNull()
        step = F.when(F.col("slope") > 0, tilt - off / F.col("slope")).otherwise(F.when(off < 0, float("inf")).otherwise(float("-inf")))
        reach = 1 + F.abs(tilt)  # one-sided so far: no more than a doubling beyond the known bound
        inside = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        after = F.when(both, inside).otherwise(F.least(F.greatest(step, tilt - reach), tilt + reach))
        met = F.abs(off) <= CLOSE * F.col("target")
        still = F.coalesce(F.col("open") & ~met & ~(both & (hi - lo <= 1e-13 * F.greatest(F.lit(1.0), F.abs(lo)))), F.lit(False))
        old = state
        state = materialise(j.select("source", "source_size", "target", "mean", F.when(still, after).otherwise(tilt).alias("tilt"), lo.alias("lo"), hi.alias("hi"), still.alias("open")), "tilts")
        discard(old)
    # to ten places: sums of doubles differ in their last ones from run to run
    return state.select("source", "source_size", "target", "mean", F.round("tilt", 10).alias("tilt"))


def _jumps(key: Column) -> Column:
    """Shifts from which a document has its first, second, ... copy."""
    unit = F.shiftrightunsigned(F.xxhash64(key, F.lit(19)), 11) * 2.0**-53
    at = _rate(F.col("tilt"), F.col("size"), F.col("mean")) + unit
    return F.array(*[F.lit(float(k)) - at for k in range(1, MOST + 1)])


def shifts(docs: DataFrame, solved: DataFrame) -> DataFrame:
    """``solved`` with ``shift``: the one whose copies bring a source nearest to its target. ``docs``: ``source, size, key``."""
    state = solved.select("*", F.lit(-2.0).alias("low"), F.lit(4.0).alias("width"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))
    state = materialise(state, "shifts")
    for i in range(ROUNDS):
        own = _of_source(docs.where("size > 0"), state.select("source", "mean", "tilt", "low", "width"))
        each = own.select("source", "size", "low", "width", F.explode(_jumps(F.col("key"))).alias("jump"))
        cut = F.greatest(F.ceil((F.col("jump") - F.col("low")) / F.col("width") * CUTS), F.lit(0))
        # in the first round jumps below the range count as given
        sums = each.select("source", "size", cut.alias("cut")).where(F.col("cut").between(0 if i == 0 else 1, CUTS)).groupBy("source", "cut").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cut"))  # CUTS + 1 rows of a source at most
        sums = sums.withColumn("upto", upto).select(F.col("source").alias("__c"), "cut", "words", "upto")
        j = state.join(sums, F.col("source").eqNullSafe(F.col("__c")), "left")
        enough = F.col("below") + F.col("upto") >= F.col("target")
        best = j.groupBy("source", "source_size", "target", "mean", "tilt", "low", "width", "below").agg(
            F.min(F.when(enough, F.struct("cut", "words", "upto"))).alias("at"), F.max("upto").alias("all")
        )
        cut = F.greatest(F.coalesce("at.cut", F.lit(CUTS)), F.lit(1))
        words = F.coalesce("at.words", F.lit(0))
        before = F.when(F.col("at").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.col("at.upto") - words)
        old = state
        state = materialise(
            best.select("source", "source_size", "target", "mean", "tilt", (F.col("low") + (cut - 1) * F.col("width") / CUTS).alias("low"), (F.col("width") / CUTS).alias("width"), (F.col("below") + before).cast("long").alias("below"), words.cast("long").alias("inside")),
            "shifts",
        )
        discard(old)
    above = F.abs(F.col("below") + F.col("inside") - F.col("target")) < F.abs(F.col("below") - F.col("target"))
    return materialise(state.select("source", "source_size", "target", "mean", "tilt", F.when(above, F.col("low") + F.col("width")).otherwise(F.col("low")).alias("shift")), "solved")


def solve(docs: DataFrame) -> DataFrame:
    """``(source, source_size, target, mean, tilt, shift)`` for ``docs``: ``source, size, key``, stored."""
    histogram = materialise(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    return shifts(docs, tilts(histogram, targets(sizes)))


def with_copies(docs: DataFrame, solved: DataFrame) -> DataFrame:
    """``docs`` (with ``source, size, key``, and whatever else) with ``source_size, target, rate, n_copies``; nothing is shuffled for few sources.

    Documents without words have no copy. Rows with equal keys and sizes get the same.
    """
    own = _of_source(docs, solved)
    n = F.aggregate(_jumps(F.col("key")), F.lit(0).cast("long"), lambda a, j: a + F.when(j <= F.col("shift"), 1).otherwise(0))
    rate = F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size"), F.col("mean"))).otherwise(0.0)
    return own.withColumn("rate", rate).withColumn("n_copies", F.when(F.col("size") > 0, n).otherwise(0).cast("long")).drop("mean", "tilt", "shift")


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, key, source, size``) with a key of its own for each of several equal rows.

    Equal rows are counted, not gathered, and dealt out again in parts of ``PART`` rows.
    """
    counted = materialise(rows.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("m")), "equal-rows")
    few = counted.where(F.col("m") <= PART).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    parts = counted.where(F.col("m") > PART).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {PART}"))))
    many = parts.repartition("key", "part").withColumn("number", F.explode(F.sequence(F.col("part") * PART, F.least(F.col("m"), (F.col("part") + 1) * PART) - 1))).drop("part")
    own = F.when(F.col("number") > 0, F.xxhash64("key", "number")).otherwise(F.col("key"))
    return few.unionByName(many).select("doc_id", own.alias("key"), "source", "size")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each document; ``taken`` counts a word once for each copy.

    Null and empty texts have no words and are not taken; a null source is a source of its own; a null
    ``doc_id`` is an identifier like any other. Rows with equal identifier, text and source are documents of
    their own, some of which may have a copy more than others. Texts of any length count whole. Other columns,
    whatever their names, are ignored. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
    own = materialise(apart(own), "sizes-of-documents")
    return with_copies(own, solve(own)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
