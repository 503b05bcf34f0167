"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become a set of hashes of normalised 13-word windows, small
enough to send to every task; documents are scanned row by row, window hashes
being built by doubling (1, 2, 4, 8 words, then 13 from two overlapping
eights). What hits is verified on the words themselves and gathered per
document. Only hits and document ids are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlex.llm.nativetext import ascii_lower, at_offsets, window_hash
from driftlex.llm.rowflags import parted, row_key
from driftlex.llm.scratch import materialise

WINDOW = 13
#: A larger set of window hashes is joined with the documents' hashes, not sent in the plan (8 bytes a hash).
MOST_SENT = 200_000
#: Windows (about 100 bytes each) that may be broadcast for verification.
MOST_BROADCAST = 400_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; none for a null text."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns h1, h2, h4, ... of hashes of the runs of words that begin at each word."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    n = 1
    while 2 * n <= max(lengths):
        df = df.withColumn(f"h{2 * n}", F.zip_with(f"h{n}", at_offsets(F.col(f"h{n}"), n), lambda x, y: F.xxhash64(x, y)))
        n *= 2
    return df


def _hashes(lengths: list[int]) -> dict[int, Column]:
    return {n: F.col(f"h{n}") for n in (1, 2, 4, 8, 16) if n <= max(lengths)}


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, hash, gram, items): the distinct windows with the ids of the items that hold them."""
    lengths = list(range(1, window + 1))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words")).where("size(words) > 0")
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window)))
    items = _with_hashes(items, lengths)
    h = _hashes(lengths)
    by_length = F.coalesce(*[F.when(F.col("length") == n, window_hash(h, n)) for n in lengths])
    whole = F.slice(by_length, F.lit(1), F.size("words") - F.col("length") + 1)
    each = items.select("item_id", "length", "words", F.posexplode(whole).alias("at", "hash"))
    gram = F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ")
    return each.select("item_id", "length", "hash", gram.alias("gram")).groupBy("length", "hash", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _among(keys: list[int]):
    return lambda x: x.isin(keys)


def _hash_among(keys: list[int]):
    return lambda x: x["hash"].isin(keys)


def _cut(n: int):
    """The words of a candidate window, from the document itself."""
    return lambda x: F.struct(x["pos"].alias("pos"), F.lit(n).alias("length"), F.array_join(F.slice(F.col("words"), x["pos"] + 1, F.lit(n)), " ").alias("gram"))


def _filtered(base: DataFrame, hashes: dict[int, Column], grams: DataFrame) -> DataFrame:
    """``found``: candidate windows of each row, by a set of hashes that the plan holds."""
    known: dict[int, list[int]] = {}
    for r in grams.select("length", "hash").distinct().collect():  # MOST_SENT at most
        known.setdefault(r["length"], []).append(r["hash"])
    parts = []
    for n, keys in sorted(known.items()):
        base = base.withColumn(f"w{n}", window_hash(hashes, n))
        at = F.transform(f"w{n}", lambda x, i: F.struct(x.alias("hash"), i.alias("pos")))
        at = F.when(F.exists(f"w{n}", _among(keys)), F.filter(at, _hash_among(keys))).otherwise(F.slice(at, 1, 0))
        # the row that verification needs: the words of each candidate window, cut from the document itself
        parts.append(F.transform(at, _cut(n)))
    return base.withColumn("found", F.concat(*parts))


def _joined(base: DataFrame, hashes: dict[int, Column], grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for any number of windows: hashes and places alone leave their rows, and what hits comes back to few rows."""
    each = F.concat(*[F.transform(window_hash(hashes, n), _numbered(n)) for n in lengths])
    windows = base.select("key", F.explode(each).alias("w")).select("key", "w.length", "w.hash", "w.pos")
    some = windows.join(grams.select("length", "hash").distinct(), ["length", "hash"], "left_semi")
    hit = materialise(some.groupBy("key").agg(F.collect_set(F.struct("length", "pos")).alias("at")), "window-hits")
    clear, maybe = parted(base, hit.select("key"))
    cut = lambda x: F.struct(x["pos"].alias("pos"), x["length"].alias("length"), F.array_join(F.slice(F.col("words"), x["pos"] + 1, x["length"]), " ").alias("gram"))
    found = maybe.join(hit, "key", "left").withColumn("found", F.coalesce(F.transform("at", cut), _none())).drop("at")
    # the two branches read the input each for itself, and may number its rows differently: their numbers are kept apart
    return clear.withColumn("found", _none()).withColumn("row", 2 * F.col("row")).unionByName(found.withColumn("row", 2 * F.col("row") + 1))


def _numbered(n: int):
    return lambda x, i: F.struct(F.lit(n).alias("length"), x.alias("hash"), i.alias("pos"))


def _none() -> Column:
    return F.array().cast("array<struct<pos:int,length:int,gram:string>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, then the columns in ``keep``.

    A word is hit inside any occurrence of a window of the benchmark; an item of fewer words than a
    window is one window. A document is contaminated if one word in twenty is hit. Null and empty
    texts have no words and hit nothing; items without words, or with a null id, are in no list; an empty
    benchmark hits nothing, and an empty table gives an empty result. Texts of any length are taken whole.
    Repeated rows are judged each by itself; other columns, whatever their names, are ignored.
    """
    grams = benchmark_windows(benchmark, window)
    per_length = {r["length"]: r["count"] for r in grams.groupBy("length").count().collect()}  # window rows at most
    total = sum(per_length.values())
    lengths = sorted(per_length) or [window]
    kept = [F.col(c).alias(f"__keep_{c}") for c in keep]
    base = docs.select(F.monotonically_increasing_id().alias("row"), row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), *kept, words_of(F.col("text").cast("string")).alias("words"))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    base = _with_hashes(base, lengths)
    h = _hashes(lengths)
    if not total:
        found = base.withColumn("found", _none())
    else:
        found = _filtered(base, h, grams) if total <= MOST_SENT else _joined(base, h, grams, lengths)
    held = ["doc_id", "n_words", *[f"__keep_{c}" for c in keep]]
    each = found.select("row", *held, F.explode_outer("found").alias("f")).select("row", *held, "f.pos", "f.length", "f.gram")
    side = grams.select("length", "gram", "items")
    hits = each.join(F.broadcast(side) if total <= MOST_BROADCAST else side, ["length", "gram"], "left")
    touched = F.when(F.col("items").isNotNull(), F.sequence("pos", F.col("pos") + F.col("length") - 1))
    per = hits.groupBy("row").agg(
        *[F.first(c).alias(c) for c in held],
        F.array_distinct(F.flatten(F.collect_list(touched))).alias("words_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    n_hit = F.size("words_hit").cast("long")
    return per.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
with w as (
  select doc_id, row_number() over () as rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
g as (
  select item_id, least(len(words), 13) as n, unnest(range(1, len(words) - least(len(words), 13) + 2)) as i, words from b where len(words) > 0),
gram as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as gram from g),
lens as (select distinct n from gram),
win as (
  select rid, n, i, array_to_string(words[i:i + n - 1], ' ') as gram
  from (select rid, words, n, unnest(range(1, len(words) - n + 2)) as i from w, lens where len(words) >= n)),
hit as (select rid, win.n, i, item_id from win join gram on win.n = gram.n and win.gram = gram.gram),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hit) group by rid),
its as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hit group by rid)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(words), false) as contaminated
from w left join pos using (rid) left join its using (rid)
"""
