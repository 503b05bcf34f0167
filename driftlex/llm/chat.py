"""Preference formatting of conversations with DataFrame functions only.

For a pair of a chosen and a rejected conversation the longest common prefix
of turns is rendered once, as the prompt; what follows in each is its
completion, with the spans of assistant text that a loss is taken on.

The query pairs conversations that begin with the same turn: in each group the
first with the second by id, the third with the fourth, and so on. Places in a
group are counted in two steps, within ranges that hold about as many ids each
and over ranges, so a very common first turn is no single task's, however
sparse the ids. Besides, a conversation with two
replies or more is paired with itself ending in a stale reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlex.llm.scratch import materialise

#: Conversations of a range whose places are counted together.
RANGE = 1024
#: Ranges at most; beyond that each holds more.
MOST_RANGES = 4096


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order as (role, text); rows with a null conv_id or turn take no part, null role or text is empty.

    Of repeated turn numbers the first by role and text stays. Other columns, whatever their names, are ignored.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    per = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    first = F.filter("t", lambda x, i: (i == 0) | (F.get(F.col("t"), i - 1)["turn"] != x["turn"]))
    return per.select(F.col("conv_id").cast("long").alias("conv_id"), F.transform(first, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both begin with."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    return F.coalesce(F.array_position(same, False).cast("int") - 1, F.lit(0)) + F.when(F.array_position(same, False) == 0, F.size(same) + 1).otherwise(0)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """start:end of each assistant text in the rendered turns, comma-joined; code points, ends exclusive."""
    size = lambda t: F.length(t["role"]) + 5 + F.length(t["text"]) + 1
    step = lambda a, t: F.struct(
        (a["at"] + size(t)).alias("at"),
        F.when(t["role"] == "assistant", F.concat(a["out"], F.array(F.concat_ws(":", (a["at"] + F.length(t["role"]) + 5).cast("string"), (a["at"] + F.length(t["role"]) + 5 + F.length(t["text"])).cast("string"))))).otherwise(a["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(turns, start, step, lambda a: F.array_join(a["out"], ","))


def preferences(pairs: DataFrame) -> DataFrame:
    """From ``chosen_id, chosen, rejected_id, rejected`` (arrays of turns) the prompt and both masked completions.

    Equal conversations have empty completions and stay, for the caller to drop. A turn has no null role or text
    (see ``conversations``); turns of any length are taken whole. No pairs give an empty result.
    """
    n = common_turns(F.col("chosen"), F.col("rejected"))
    p = pairs.withColumn("n_common", n)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return p.select(
        "chosen_id",
        "rejected_id",
        "n_common",
        rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"),
        rendered(rest("rejected")).alias("rejected"),
        mask(rest("chosen")).alias("chosen_mask"),
        mask(rest("rejected")).alias("rejected_mask"),
    )


def paired(convs: DataFrame) -> DataFrame:
    """Pairs of conversations with the same first turn; chosen is the one with more assistant text, of equals the smaller id.

    The last of an odd number has no pair; conversations without turns take no part. An empty table gives none.
    """
    said = F.aggregate(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0), lambda a, t: a + F.length(t["text"]))
    head = F.sha2(F.concat(F.col("turns")[0]["role"], F.lit("\x1f"), F.col("turns")[0]["text"]), 256)
    convs = materialise(convs.where("size(turns) > 0").withColumn("head", head).withColumn("said", said), "conversations")
    ranges = max(1, min(MOST_RANGES, -(-convs.count() // RANGE)))
    dealt = convs.select("conv_id", "head").repartitionByRange(ranges, "conv_id").withColumn("range", F.spark_partition_id())
    places = materialise(dealt, "places")
    before = places.groupBy("head", "range").agg(F.count("*").alias("n"))
    along = Window.partitionBy("head").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("head", "range", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("head", "range").orderBy("conv_id"))
    place = places.withColumn("inner", inner).join(before, ["head", "range"]).select("conv_id", "head", (F.col("inner") + F.col("before") - 1).alias("place"))
    pair = place.select("conv_id", "head", F.floor(F.col("place") / 2).alias("pair"))
    ids = pair.groupBy("head", "pair").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).where("a < b").select("a", "b")
    side = lambda x: convs.select(F.col("conv_id").alias(x), F.struct("conv_id", "turns", "said").alias(f"c{x}"))
    both = ids.join(side("a"), "a").join(side("b"), "b")
    first = F.col("ca.said") >= F.col("cb.said")
    pick = lambda f, x, y: F.when(first, F.col(f"c{x}.{f}")).otherwise(F.col(f"c{y}.{f}"))
    return both.select(pick("conv_id", "a", "b").alias("chosen_id"), pick("turns", "a", "b").alias("chosen"), pick("conv_id", "b", "a").alias("rejected_id"), pick("turns", "b", "a").alias("rejected"))


def stale_replies(convs: DataFrame) -> DataFrame:
    """Pairs within a conversation of two assistant turns or more: rejected ends with the first reply in place of the last.

    Both end there; conversations whose two replies are equal give none.
    """
    at = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    c = convs.withColumn("at", at).withColumn("first", F.try_element_at("at", F.lit(1))).withColumn("last", F.try_element_at("at", F.lit(-1)))
    reply = lambda i: F.get(F.col("turns"), F.col(i) - 1)
    c = c.where((F.col("first") < F.col("last")) & (reply("first")["text"] != reply("last")["text"]))
    rejected = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(reply("first")))
    return c.select(F.col("conv_id").alias("chosen_id"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), F.col("conv_id").alias("rejected_id"), rejected.alias("rejected"))


def op9_preference_format(spark, sf_dir: str) -> DataFrame:
    convs = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return preferences(paired(convs).unionByName(stale_replies(convs)))


OP9_SQL = """
with o as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
c as (select conv_id, list({'role': role, 'text': text} order by turn) as t, sum(case when role = 'assistant' then length(text) else 0 end) as said from o group by 1),
p as (select *, (row_number() over (partition by t[1].role, t[1].text order by conv_id) - 1) // 2 as pair from c),
j as (select a.conv_id as ai, b.conv_id as bi, a.t as ta, b.t as tb, a.said >= b.said as f from p a join p b on a.t[1].role = b.t[1].role and a.t[1].text = b.t[1].text and a.pair = b.pair and a.conv_id < b.conv_id),
s as (select conv_id, t, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') as x from c),
k as (
  select case when f then ai else bi end as chosen_id, case when f then bi else ai end as rejected_id, case when f then ta else tb end as ct, case when f then tb else ta end as rt from j
  union all select conv_id, conv_id, t[1:x[-1]], list_append(t[1:x[-1] - 1], t[x[1]]) from s where len(x) > 1 and t[x[1]].text <> t[x[-1]].text),
n as (select *, coalesce((select min(i) - 1 from unnest(range(1, greatest(len(ct), len(rt)) + 1)) u(i) where ct[i] is distinct from rt[i]), len(ct)) as n from k),
r as (select *, list_transform(ct, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10)) as cr, list_transform(rt, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10)) as rr from n),
m as (
  select *, list_filter(list_transform(range(n + 1, len(ct) + 1), lambda i: case when ct[i].role = 'assistant' then cast(length(array_to_string(cr[n + 1:i], '')) - length(ct[i].text) - 1 as varchar) || ':' || cast(length(array_to_string(cr[n + 1:i], '')) - 1 as varchar) end), lambda x: x is not null) as cm,
    list_filter(list_transform(range(n + 1, len(rt) + 1), lambda i: case when rt[i].role = 'assistant' then cast(length(array_to_string(rr[n + 1:i], '')) - length(rt[i].text) - 1 as varchar) || ':' || cast(length(array_to_string(rr[n + 1:i], '')) - 1 as varchar) end), lambda x: x is not null) as rm from r)
select chosen_id, rejected_id, cast(n as integer) as n_common, array_to_string(cr[1:n], '') as prompt, array_to_string(cr[n + 1:], '') as chosen, array_to_string(rr[n + 1:], '') as rejected,
  array_to_string(cm, ',') as chosen_mask, array_to_string(rm, ',') as rejected_mask from m
"""
