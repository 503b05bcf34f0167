"""How document filters interact: what each removes at each place of each order of them.

A document's failures are bits of a mask. For each part and label, the 32 sums
over documents of (-1)^|k & mask|, for k from 0 to 31, are the Walsh-Hadamard
transform of the counts by mask; the same transform, divided by 32, gives the
counts back exactly. All 120 orders are then evaluated on 32 counts and not on
documents. Of the orders, a document that fails n filters is removed by each of
them first in 120 / n, which gives the Shapley sums in closed form.

Texts are read once; a 128-bit hash stands for a text from then on.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlex.llm.scratch import materialise

LETTERS = "ABCDE"
CELLS = 1 << len(LETTERS)
#: Fewest words; least distinct words and most capitals, in hundredths; signs that no text may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
REPEATED = 1 << LETTERS.index("E")


def _text_failures() -> Column:
    """Bits A to D of ``__text``, whose words are ``__words``."""
    words = F.size("__words").cast("long")
    failed = (
        words < LEAST_WORDS,
        100 * F.size(F.array_distinct("__words")).cast("long") < LEAST_DISTINCT * words,
        100 * F.regexp_count("__text", F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length("__text").cast("long"),
        F.rlike("__text", F.lit(SIGNS)),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document.

    A null text is an empty one; empty texts repeat each other. Identical to a smaller id's text are all rows but
    those of a text's smallest id; a null id is neither smaller nor larger than another. Rows with equal ids are
    documents of their own, with their id's labels; a label is 1 if any row of ``labels`` says so.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    own = own.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    # an id of null joins nothing; such rows are dealt by their text
    spread = F.when(F.col("doc_id").isNull(), F.col("one")).otherwise(0)
    digest = F.md5("__text")
    slim = own.select("doc_id", "part", _text_failures().alias("mask"), F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").alias("one"), F.conv(F.substring(digest, 17, 16), 16, -10).cast("long").alias("two"))
    slim = materialise(slim.withColumn("spread", spread), "failures")
    first = slim.where("doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.withColumn("spread", F.lit(0).cast("long"))
    judged = slim.join(first, ["doc_id", "one", "two"], "left").join(known, ["doc_id", "spread"], "left")
    repeated = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), REPEATED).otherwise(0)
    return judged.select("part", (F.col("mask") + repeated).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _sign(k: Column, mask: Column) -> Column:
    return 1 - 2 * (F.bit_count(k.bitwiseAND(mask)) % 2)


def spectrum(judged: DataFrame) -> DataFrame:
    """(part, label, sums): the 32 signed sums of each part, over all its documents, the good and the toxic ones."""
    kinds = F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    each = judged.select("part", "mask", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("label"))
    sums = [F.sum(_sign(F.lit(k), F.col("mask")).cast("long")).alias(f"s{k}") for k in range(CELLS)]
    return each.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{k}" for k in range(CELLS)]).alias("sums"))


def cells(transformed: DataFrame) -> DataFrame:
    """(part, label, counts): documents by mask, from the inverse transform."""
    signed = lambda m: F.zip_with("sums", F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda s, k: s * _sign(k, m))
    total = lambda m: F.aggregate(signed(m), F.lit(0).cast("long"), lambda a, x: a + x)
    counts = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.shiftright(total(m), len(LETTERS)))
    return transformed.select("part", "label", counts.alias("counts"))


def orders(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    of = lambda label: F.coalesce(F.max(F.when(F.col("label") == label, F.col("counts"))), none).alias(label)
    wide = counted.groupBy("part").agg(of("all"), of("good"), of("toxic"))
    steps = [(order, i + 1, 1 << LETTERS.index(x), sum(1 << LETTERS.index(y) for y in order[:i])) for order in map("".join, permutations(LETTERS)) for i, x in enumerate(order)]
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, i, own, before in steps])
    own, before = F.col("p.own"), F.col("p.before")

    def total(counts: str, weight) -> Column:
        """Sum of the counts times a weight of their masks."""
        return F.aggregate(F.transform(counts, lambda n, m: n * weight(m)), F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: F.when(fails(m, own) & ~fails(m, before), 1).otherwise(0)
    return wide.select("part", "all", "good", "toxic", F.explode(plan).alias("p")).select(
        "part",
        "p.filter_order",
        "p.step",
        total("all", lambda m: F.when(fails(m, own.bitwiseOR(before)), 0).otherwise(1)).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: F.when(fails(m, own) & fails(m, before), 1).otherwise(0)).alias("redundant"),
        total("all", lambda m: F.when(m == own, 1).otherwise(0)).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("all", lambda m: F.when(fails(m, own), (F.lit(120) / F.bit_count(m)).cast("int")).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders and steps of each part, zeros included; see ``failures`` for what counts as what.

    Only doc_id, source and text, and of ``labels`` doc_id, quality and toxic are read, whatever other columns
    there are. Without documents there is no part and no row.
    """
    return orders(materialise(cells(spectrum(failures(docs, labels))), "cells"))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as first_id from d),
f as (select doc_id, part, len(words) < 200 as a, 100 * list_unique(words) < 50 * len(words) as b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > first_id, false) as e from w),
l as (select doc_id, coalesce(max(quality = 1), false) as good, coalesce(max(toxic = 1), false) as toxic from labels group by 1),
m as (select part, cast(a as integer) + 2 * cast(b as integer) + 4 * cast(c as integer) + 8 * cast(d as integer) + 16 * cast(e as integer) as mask,
    count(*) as n, count(*) filter (good) as n_good, count(*) filter (l.toxic) as n_toxic
  from f left join l using (doc_id) group by 1, 2),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from x a, x b, x c, x d, x e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, cast(step as integer) as step, bits[step] as own, cast(coalesce(list_sum(bits[:step - 1]), 0) as integer) as before from o cross join range(1, 6) r(step))
select part, filter_order, step, cast(sum(case when mask & (own | before) = 0 then n else 0 end) as bigint) as kept,
  cast(sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as bigint) as removed,
  cast(sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as bigint) as redundant,
  cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when mask & own <> 0 and mask & before = 0 then n_good else 0 end) as bigint) as good_lost,
  cast(sum(case when mask & own <> 0 and mask & before = 0 then n_toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when mask & own <> 0 then n * (120 // bit_count(mask)) else 0 end) as bigint) as shapley
from m cross join s group by 1, 2, 3"""
