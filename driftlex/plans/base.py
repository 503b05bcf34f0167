"""Views of the test tables that stand for corpora and responses, and the registry's decorator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlex.functions import text as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SINGLES = ["the", "of", "and", "la", "der", "und", "is", "haha", "hahaha"]
PHRASES = ["of the", "the and", "the the", "orre orre", "and the"]
LEAST_SCORE = 0.5


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir: str) -> DataFrame:
    """documents as a crawl corpus: ``doc_id, text, lang, source, dump, year, uri``."""
    d = table(spark, sf_dir, "documents")
    s = F.substring("source", 4, 9).cast("int")
    return d.select("doc_id", "text", "lang", "source", F.concat(F.lit("CC-MAIN-"), (2013 + s % 12).cast("string"), F.lit("-"), F.lpad((5 + s).cast("string"), 2, "0")).alias("dump"), (2013 + s % 12).alias("year"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("uri"))


def pseudo_score(doc_id: Column, pos: Column) -> Column:
    """A stand-in for a sense model on a grid of ten-thousandths; null for every 37th document."""
    return F.when(doc_id % 37 != 0, ((doc_id * 7919 + pos * 104729) % 20001 - 10000) / 10000.0)


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PUNCT = T.PUNCTUATION.replace("'", "''")
WS = T.WS
#: with-clauses: corpus; tokens with keys by position; tokens by year and by crawl
CORPUS = """corpus as (
  select doc_id, text, lang, source, 'CC-MAIN-' || cast(2013 + s % 12 as varchar) || '-' || lpad(cast(5 + s as varchar), 2, '0') as dump,
    2013 + s % 12 as year, 'https://' || source || '.example.com/' || cast(doc_id as varchar) as uri
  from (select *, cast(substr(source, 4) as integer) as s from documents))"""
KEYS = f"""{CORPUS},
toks as (select doc_id, dump, year, uri, regexp_extract_all(text, '[^{WS}]+[{WS}]*') as pieces from corpus where text is not null),
keys as (
  select doc_id, dump, year, uri, pieces, pos, lower(trim(regexp_replace(piece, '[{WS}]+$', ''), '{_PUNCT}')) as key
  from (select *, unnest(pieces) as piece, unnest(range(len(pieces))) as pos from toks))"""
TOKENS = f"sizes as (select dump, year, sum(len(regexp_extract_all(text, '[^{WS}]+'))) as tokens from corpus group by 1, 2)"
HITS = f"{KEYS}, hits as (select doc_id, dump, year, uri, pos, key as target from keys where key in ({quoted(SINGLES)}))"
SCORED = HITS + """, scored as (
  select *, case when doc_id % 37 <> 0 then ((doc_id * 7919 + pos * 104729) % 20001 - 10000) / 10000.0::double end as sense_score from hits)"""
RATES = f"""{HITS}, {TOKENS},
counts as (select year, target, count(*) as hits from hits group by 1, 2),
ytok as (select year, cast(sum(tokens) as bigint) as tokens from sizes group by 1),
rates as (
  select y.year, w.target, coalesce(c.hits, 0) as hits, coalesce(c.hits, 0) * 1000000 / t.tokens as rate
  from (select distinct year from counts) y cross join (select distinct target from counts) w
  left join counts c on c.year = y.year and c.target = w.target join ytok t on t.year = y.year)"""
PEAKS = RATES + """,
peaks as (
  select target, year as peak_year, rate as peak_rate, (select sum(hits) from rates r2 where r2.target = r.target) as total_hits
  from (select *, row_number() over (partition by target order by rate desc, year) as rn from rates) r where rn = 1),
pct as (select r.year, r.target, r.hits, r.rate, case when p.peak_rate > 0 then 100 * r.rate / p.peak_rate end as pct_of_peak from rates r join peaks p using (target))"""
