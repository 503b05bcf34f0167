"""Corpus queries: contexts, counts, rates, peaks, smoothing, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlex.functions import dumps as D
from driftlex.functions import text as T
from driftlex.operators import annotation, langscore, mixtures, rates, sampling, scoring, sensemodel, trajectory
from driftlex.operators import stats as S
from driftlex.operators.kwic import count_targets, kwic, kwic_tokens, prefilter_pattern
from driftlex.plans.base import CORPUS, HITS, KEYS, LEAST_SCORE, PEAKS, PHRASES, RATES, SCORED, SINGLES, TOKENS, WS, corpus, pseudo_score, query, quoted, table
from driftlex.sources.shared import stored


def _chance(keys: str, seed: int) -> str:
    return f"left(md5(concat_ws('|', {keys}, '{seed}')), 16)"


_RTRIM = f"regexp_replace(array_to_string(%s, ''), '[{WS}]+$', '')"


def hits(spark, d: str) -> DataFrame:
    return kwic(corpus(spark, d), SINGLES, 0, ("doc_id", "dump", "year", "uri"), context=False)


def scored(spark, d: str) -> DataFrame:
    return hits(spark, d).withColumn("sense_score", pseudo_score(F.col("doc_id"), F.col("pos")))


def totals(spark, d: str) -> DataFrame:
    """(dump, year, target, n): all counts that trends need, from one scan."""
    return count_targets(corpus(spark, d), SINGLES, ("dump", "year"))


def year_rates(spark, d: str) -> DataFrame:
    t = totals(spark, d)
    tokens = t.where("target is null").groupBy("year").agg(F.sum("n").alias("tokens"))
    counts = t.where("target is not null").groupBy("year", "target").agg(F.sum("n").alias("hits"))
    grid = rates.dense(counts, counts.select("year").distinct(), counts.select("target").distinct())
    return rates.with_rate(grid, tokens, "year")


@query(f"with {HITS.replace('select doc_id, dump, year, uri, pos, key as target from keys', 'select doc_id, dump, pos, key as target, pieces from keys')} select doc_id, dump, cast(pos as integer) as pos, target, {_RTRIM % 'pieces[greatest(pos - 20, 0) + 1:pos + 21]'} as target_context from hits where target in ('haha', 'hahaha', 'la', 'und', 'is')")
def kwic_single(spark, d):
    return kwic(corpus(spark, d), ["haha", "hahaha", "la", "und", "is"], 20, ("doc_id", "dump"))


@query(
    f"""with {KEYS},
cand as (select a.doc_id, a.pos, a.key || ' ' || b.key as target, a.pieces from keys a join keys b on b.doc_id = a.doc_id and b.pos = a.pos + 1 where a.key || ' ' || b.key in ({quoted(PHRASES)})),
runs as (select *, pos - row_number() over (partition by doc_id order by pos) as grp from cand),
kept as (select *, row_number() over (partition by doc_id, grp order by pos) as r from runs)
select doc_id, cast(pos as integer) as pos, target, {_RTRIM % 'pieces[greatest(pos - 5, 0) + 1:pos + 7]'} as target_context from kept where r % 2 = 1"""
)
def kwic_phrase(spark, d):
    return kwic(corpus(spark, d), PHRASES, 5, ("doc_id",))


@query(
    f"""with {CORPUS},
t as (select doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z''’-]+'), lambda x: lower(x)) as ws from corpus),
k as (select doc_id, ws, unnest(ws) as key, unnest(range(len(ws))) as pos from t)
select doc_id, cast(pos as integer) as pos, key as target, array_to_string(ws[greatest(pos - 10, 0) + 1:pos + 11], ' ') as target_context from k where key in ('haha', 'la', 'und')"""
)
def kwic_cc(spark, d):
    return kwic_tokens(corpus(spark, d), ["haha", "la", "und"], 10, ("doc_id",))


@query(rf"with {CORPUS} select doc_id, dump from corpus where regexp_matches(text, '(?i)(?:^|\s)[[:punct:]]*(?:haha|of\s+the)[[:punct:]]*(?:\s|$)')")
def prefilter_docs(spark, d):
    return corpus(spark, d).where(F.col("text").rlike(prefilter_pattern(["haha", "of the"]))).select("doc_id", "dump")


@query(f"with {CORPUS} select doc_id, dump from corpus where year >= 2015 and dump >= 'CC-MAIN-2015' and dump <= 'CC-MAIN-2020-15'")
def dump_filter(spark, d):
    return corpus(spark, d).where(D.in_range(F.col("dump"), 2015, "CC-MAIN-2015", "CC-MAIN-2020-15")).select("doc_id", "dump")


@query(f"with {HITS} select g.dump, g.target, cast(coalesce(c.hits, 0) as bigint) as hits from (select distinct dump, w.target from corpus cross join (select unnest([{quoted(SINGLES)}]) as target) w) g left join (select dump, target, count(*) as hits from hits group by 1, 2) c on c.dump = g.dump and c.target = g.target")
def dump_counts(spark, d):
    words = spark.createDataFrame([(w,) for w in SINGLES], "target string")
    t = totals(spark, d)
    counts = t.where("target is not null").select("dump", "target", F.col("n").alias("hits"))
    return rates.dense(counts, t.select("dump").distinct(), words)


@query(f"with {HITS} select distinct year from hits where year % 4 = 0")
def missing_totals(spark, d):
    """Years that have counts but no total of tokens."""
    t = totals(spark, d)
    tokens = t.where("target is null and year % 4 <> 0").groupBy("year").agg(F.sum("n").alias("tokens"))
    return rates.missing_tokens(t.where("target is not null").select("year", "target", F.col("n").alias("hits")), tokens, "year").select("year").distinct()


@query(f"with {CORPUS}, {TOKENS} select dump, cast(tokens as bigint) as tokens from sizes")
def token_totals(spark, d):
    return corpus(spark, d).groupBy("dump").agg(F.sum(T.n_tokens("text")).alias("tokens"))


@query(f"with {RATES} select year, target, cast(hits as bigint) as hits, rate as rate_per_million from rates")
def rate_per_million(spark, d):
    return year_rates(spark, d)


@query(f"with {PEAKS} select target, peak_year, peak_rate as peak_rate_per_million, cast(total_hits as bigint) as total_hits from peaks where total_hits >= 30")
def peak_year(spark, d):
    return rates.gated(rates.peaks(year_rates(spark, d)))


@query(f"with {PEAKS} select year, target, pct_of_peak from pct")
def pct_of_peak(spark, d):
    return rates.percent_of_peak(year_rates(spark, d)).select("year", "target", "pct_of_peak")


@query(f"with {PEAKS} select target, count(*) as years, max(pct_of_peak) as top, sum(rate) as rate_sum from pct group by 1")
def peak_records(spark, d):
    r = rates.records(year_rates(spark, d))
    return r.select("target", F.size("rate_by_year").cast("long").alias("years"), F.array_max(F.map_values("pct_of_peak_by_year")).alias("top"), F.aggregate(F.map_values("rate_by_year"), F.lit(0.0), lambda a, x: a + x).alias("rate_sum"))


_GRID = f"""with {HITS}, {TOKENS},
days as (select cast(date_trunc('week', make_date(year, 1, 4)) as date) + cast(7 * (cast(right(dump, 2) as integer) - 1) as integer) as day, sum(tokens) as tokens, dump from sizes group by dump, year),
grid as (
  select w.target, d.day, d.tokens, coalesce(c.hits, 0) as hits from days d cross join (select unnest([{quoted(SINGLES)}]) as target) w
  left join (select dump, target, count(*) as hits from hits group by 1, 2) c on c.dump = d.dump and c.target = w.target)"""


def date_grid(spark, d: str) -> DataFrame:
    t = totals(spark, d)
    words = spark.createDataFrame([(w,) for w in SINGLES], "target string")
    tokens = t.where("target is null").select("dump", F.col("n").alias("tokens"))
    counts = t.where("target is not null").select("dump", "target", F.col("n").alias("hits"))
    grid = rates.dense(counts, tokens.select("dump"), words).join(F.broadcast(tokens), "dump")
    return grid.groupBy("target", D.monday_of(F.col("dump")).alias("day")).agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens"))


@query(_GRID + ", w as (select target, day, sum(hits) over win as k, sum(tokens) over win as n from grid window win as (partition by target order by day rows between 4 preceding and 4 following)) select target, cast(day as varchar) as day, cast(k as bigint) as window_hits, cast(n as bigint) as window_tokens, cast(k as bigint) * 1000000 / cast(n as bigint) as smoothed_rate from w")
def smoothed_rate(spark, d):
    return rates.smoothed(date_grid(spark, d), "day", 9).drop("hits", "tokens").withColumn("day", F.col("day").cast("string"))


@query(_GRID + " select target, cast(day as varchar) as day, sum(hits) over win / count(*) over win as smoothed_hits from grid window win as (partition by target order by day rows between 2 preceding and 2 following)")
def smoothed_count(spark, d):
    return rates.smoothed_counts(date_grid(spark, d), "day", 5).select("target", F.col("day").cast("string").alias("day"), "smoothed_hits")


# bounds by bisection on sums of Poisson terms
@query(
    _GRID.replace("with ", "with recursive ", 1)
    + """, w as (select target, day, cast(sum(hits) over win as bigint) as k, cast(sum(tokens) over win as bigint) as n from grid window win as (partition by target order by day rows between 4 preceding and 4 following)),
ks as (select distinct k, range(greatest(0, cast(floor(k - 14 * sqrt(k) - 60) as bigint)), k + 1) as i from w),
b as (
  select 0 as step, k, i, greatest(0.0::double, k - 8 * sqrt(k) - 20) as la, cast(k as double) as lb, cast(k as double) as ha, k + 8 * sqrt(k) + 20 as hb from ks
  union all
  select step + 1, k, i, case when pl < 0.025 then lm else la end, case when pl < 0.025 then lb else lm end, case when ph > 0.025 then hm else ha end, case when ph > 0.025 then hb else hm end
  from (select *, 1 - coalesce(list_sum(list_transform(list_filter(i, lambda x: x < k), lambda x: exp(x * ln(lm) - lm - lgamma(x + 1)))), 0) as pl,
      list_sum(list_transform(i, lambda x: exp(x * ln(hm) - hm - lgamma(x + 1)))) as ph
    from (select *, greatest((la + lb) / 2, 1e-300) as lm, greatest((ha + hb) / 2, 1e-300) as hm from b where step < 52))),
bounds as (select k, case when k = 0 then 0.0 else (la + lb) / 2 end as low, (ha + hb) / 2 as high from b where step = 52)
select target, cast(day as varchar) as day, w.k as window_hits, w.k * 1000000 / n as smoothed_rate, round(low * 1000000 / n, 4) as rate_low, round(high * 1000000 / n, 4) as rate_high from w join bounds using (k)"""
)
def poisson_ci(spark, d):
    """The smoothed rate with its exact bounds."""
    r = rates.with_interval(rates.smoothed(date_grid(spark, d), "day", 9))
    return r.select("target", F.col("day").cast("string").alias("day"), "window_hits", "smoothed_rate", F.round("rate_low", 4).alias("rate_low"), F.round("rate_high", 4).alias("rate_high"))


@query(
    _GRID
    + """, w as (select target, day, cast(sum(hits) over win as bigint) as k, cast(sum(tokens) over win as bigint) as n from grid window win as (partition by target order by day rows between 4 preceding and 4 following)),
r as (select target, day, k, k * 1000000 / n as y from w), p as (select *, max(y) over (partition by target) as top from r)
select target, cast(day as varchar) as day, case when top > 0 then 100 * y / top else y end as pct, k > 0 as marked, true as inside from p"""
)
def pct_of_peak_interval(spark, d):
    r = rates.percent_of_peak_with_interval(rates.with_interval(rates.smoothed(date_grid(spark, d), "day", 9)))
    marked = rates.nonzero(r).select("target", "day", F.lit(True).alias("marked"))
    r = r.join(marked, ["target", "day"], "left")
    inside = (F.col("rate_low") <= F.col("smoothed_rate")) & (F.col("smoothed_rate") <= F.col("rate_high"))
    return r.select("target", F.col("day").cast("string").alias("day"), F.col("smoothed_rate").alias("pct"), F.coalesce("marked", F.lit(False)).alias("marked"), inside.alias("inside"))


@query(f"with {RATES} select year, target, cast(hits as bigint) as k from rates")
def reconstructed(spark, d):
    tokens = totals(spark, d).where("target is null").groupBy("year").agg(F.sum("n").alias("tokens"))
    return rates.reconstructed_counts(year_rates(spark, d), tokens).select("year", "target", "k")


# least squares on polynomials made orthogonal one after another
@query(
    _GRID
    + """, g as (select target, day, epoch(cast(day as timestamp)) / 86400 as x, hits * 1000000.0::double / tokens as y from grid),
z as (select target, day, y, (x - avg(x) over t) / stddev_pop(x) over t as z from g window t as (partition by target)),
p2 as (select *, z * z - avg(z * z) over t - z * sum(z * z * z) over t / sum(z * z) over t as q from z window t as (partition by target)),
p3 as (select *, z * z * z - avg(z * z * z) over t - z * sum(z * z * z * z) over t / sum(z * z) over t - q * sum(z * z * z * q) over t / sum(q * q) over t as c from p2 window t as (partition by target))
select target, cast(day as varchar) as day, round(greatest(0.0, avg(y) over t + z * sum(y * z) over t / sum(z * z) over t + q * sum(y * q) over t / sum(q * q) over t + c * sum(y * c) over t / sum(c * c) over t), 4) as fitted
from p3 window t as (partition by target)"""
)
def cubic_fit(spark, d):
    """A least-squares cubic for each word, cut at zero."""
    g = date_grid(spark, d).withColumn("rate", F.col("hits") * 1e6 / F.col("tokens")).withColumn("x", F.unix_date("day").cast("double")).select("target", "day", "x", "rate")
    return rates.cubic(g, "x", "rate").select("target", F.col("day").cast("string").alias("day"), F.round("fitted", 4).alias("fitted"))


@query(f"with {CORPUS} select distinct dump, cast(cast(date_trunc('week', make_date(year, 1, 4)) as date) + cast(7 * (cast(right(dump, 2) as integer) - 1) as integer) as varchar) as monday from corpus")
def iso_week_date(spark, d):
    return corpus(spark, d).select("dump").distinct().withColumn("monday", D.monday_of(F.col("dump")).cast("string"))


@query(
    f"""with {PEAKS},
d1 as (select *, pct_of_peak - lag(pct_of_peak) over w as d from pct window w as (partition by target order by year)),
d2 as (select *, lead(d) over (partition by target order by year) as dn from d1),
a as (select target, count(*) as n, sum(abs(d)) as moved, max(pct_of_peak) - min(pct_of_peak) as span, sqrt(avg((dn - d) * (dn - d))) as bend, stddev_samp(pct_of_peak) as sd, sum(case when d * dn < 0 then 1 else 0 end) as turns from d2 group by 1)
select target, n, case when n >= 3 and span > 0 then moved / span end as total_variation, case when n >= 3 and span > 0 then bend / sd end as roughness,
  case when n >= 3 and span > 0 then cast(turns as bigint) end as turns, case when n >= 3 and span > 0 then (turns - 2 * (n - 2) / 3) / sqrt((16 * n - 29) / 90) end as turns_z from a"""
)
def trajectory_metrics(spark, d):
    return trajectory.roughness(rates.percent_of_peak(year_rates(spark, d)))


_PARABOLA = """x as (select *, cast(row_number() over (partition by target order by year) - 1 as double) as x from {0}),
m as (select target, count(*) as n, sum(x) as s1, sum(x*x) as s2, sum(x*x*x) as s3, sum(x*x*x*x) as s4, sum({1}) as t0, sum(x*{1}) as t1, sum(x*x*{1}) as t2, avg({1}) as mean from x group by 1),
c as (select *, n * (s2*s4 - s3*s3) - s1 * (s1*s4 - s3*s2) + s2 * (s1*s3 - s2*s2) as det from m),
k as (select *, (t0 * (s2*s4 - s3*s3) - s1 * (t1*s4 - s3*t2) + s2 * (t1*s3 - s2*t2)) / det as c0, (n * (t1*s4 - s3*t2) - t0 * (s1*s4 - s3*s2) + s2 * (s1*t2 - t1*s2)) / det as c1,
  (n * (s2*t2 - t1*s3) - s1 * (s1*t2 - t1*s2) + t0 * (s1*s3 - s2*s2)) / det as c2 from c),
f as (select x.*, k.mean, c0 + c1 * x.x + c2 * x.x * x.x as fit from x join k on x.target = k.target)"""


@query(f"with {PEAKS}, {_PARABOLA.format('pct', 'pct_of_peak')} select target, count(*) as n, round(1 - sum((pct_of_peak - fit) * (pct_of_peak - fit)) / sum((pct_of_peak - mean) * (pct_of_peak - mean)), 6) as r2 from f group by 1")
def series_spread(spark, d):
    """How much of a series' spread its parabola explains."""
    s = trajectory.quadratic(rates.percent_of_peak(year_rates(spark, d)))
    return s.groupBy("target").agg(F.count("*").alias("n"), F.round(F.first("r2"), 6).alias("r2"))


@query(
    f"""with {PEAKS}, {_PARABOLA.format('rates', 'rate')},
z as (select f.*, ytok.tokens / 1e6 as mt from f join ytok using (year))
select target, round(1 - sum((rate - fit) * (rate - fit)) / sum((rate - mean) * (rate - mean)), 6) as r2,
  round(sqrt(sum((rate - fit) * (rate - fit) * mt * mt / greatest(fit * mt, 0.5)) / (count(*) - 3)), 6) as noise_multiple from z group by 1"""
)
def quadratic_noise(spark, d):
    c = totals(spark, d).where("target is null").groupBy("year").agg(F.sum("n").alias("tokens"))
    fitted = trajectory.quadratic(year_rates(spark, d), "rate_per_million").join(F.broadcast(c), "year")  # a row for each year
    out = fitted.groupBy("target").agg(F.first("r2").alias("r2")).join(trajectory.noise(fitted), "target")
    return out.select("target", F.round("r2", 6).alias("r2"), F.round("noise_multiple", 6).alias("noise_multiple"))


@query(f"with {RATES}, h as (select target, list_sort(list(hits) filter (where hits > 0)) as h from rates group by 1) select target, 100 / sqrt(h[len(h) // 2 + 1]) as se_pct from h")
def standard_error(spark, d):
    return trajectory.standard_error(year_rates(spark, d))


@query(f"with {PEAKS} select target, year as min_year, pct_of_peak as min_pct from (select *, row_number() over (partition by target order by pct_of_peak, year) as rn from pct) where rn = 1")
def min_year(spark, d):
    return trajectory.lowest(rates.percent_of_peak(year_rates(spark, d)))


@query(f"with {PEAKS} select p.target, year, year - peak_year as from_peak, pct_of_peak from pct p join peaks using (target)")
def peak_aligned(spark, d):
    r = year_rates(spark, d)
    return trajectory.aligned(rates.percent_of_peak(r), rates.peaks(r)).select("target", "year", "from_peak", "pct_of_peak")


_HIST = f"with {SCORED}, hist as (select target, cast(round_even(sense_score * 10000, 0) as bigint) as bin, count(*) as n from scored where sense_score is not null group by 1, 2)"


@query(_HIST + " select * from hist")
def score_hist(spark, d):
    return rates.score_histogram(scored(spark, d))


@query(
    _HIST
    + """, a as (select coalesce(target, 'ALL') as target, cast(sum(n) as bigint) as occurrences, cast(sum(case when bin >= 0 then n else 0 end) as bigint) as k0, cast(sum(case when bin >= 9900 then n else 0 end) as bigint) as k99 from hist group by rollup (target))
select target, occurrences, k0 as "kept_at_0", k99 as "kept_at_0.99", 100.0::double * (occurrences - k0) / occurrences as "pct_filtered_at_0", 100.0::double * (occurrences - k99) / occurrences as "pct_filtered_at_0.99" from a"""
)
def filter_rates(spark, d):
    return rates.filter_rates(rates.score_histogram(scored(spark, d)), (0, 0.99))


@query(
    f"""with {PEAKS}, low as (select target, min(pct_of_peak) as min_pct from pct group by 1), s as (select * from (select doc_id, pos, key as target from keys where key in ({quoted(SINGLES)})) where doc_id % 37 <> 0),
f as (select target, 100.0::double * sum(case when ((doc_id * 7919 + pos * 104729) % 20001 - 10000) < 5000 then 1 else 0 end) / count(*) as pct_filtered from s group by 1)
select target, cast(total_hits as bigint) as total_hits, min_pct, pct_filtered from peaks join low using (target) left join f using (target) where total_hits >= 80 and min_pct <= 50 and coalesce(pct_filtered <= 80, true)"""
)
def ephemeral_targets(spark, d):
    r = year_rates(spark, d)
    stats = rates.peaks(r).select("target", "total_hits").join(trajectory.lowest(rates.percent_of_peak(r)).select("target", "min_pct"), "target")
    f = rates.filter_rates(rates.score_histogram(scored(spark, d)), (0.5,)).where("target <> 'ALL'").select("target", F.col("`pct_filtered_at_0.5`").alias("pct_filtered"))
    return trajectory.ephemeral(stats, f)


_QUALITY = f"""q as (
  select doc_id, text, n, case when n < 8 then 0.0::double else greatest(0.0::double, least(1.0::double, 1.0::double
    - case when f / n < 0.04 then 0.5::double when f / n < 0.08 then 0.2::double else 0.0::double end - case when c / n > 0.12 then 0.4::double when c / n > 0.06 then 0.15::double else 0.0::double end - case when b / n > 0.04 then 0.4::double else 0.0::double end)) end as quality_score
  from (select doc_id, text, len(t) as n, len(list_filter(t, lambda x: lower(trim(x, '.,!?;:"''()[]{{}}-')) in ({quoted(list(scoring.FUNCTION_WORDS))}))) as f,
    length(text) - length(replace(text, ',', '')) as c, length(text) - length(replace(text, '|', '')) + (length(text) - length(replace(text, ' / ', ''))) / 3 as b
    from (select doc_id, text, regexp_extract_all(text, '[^{WS}]+') as t from documents)))"""


@query(f"with {_QUALITY} select doc_id, quality_score from q")
def quality_score(spark, d):
    return scoring.with_quality(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "quality_score")


# trigrams of every text, those of texts that may be learned from by language, and each text's score
_ENGLISH = f"""chars as (select doc_id, lang, doc_id % 5 = 0 as held_out, list_transform(string_split(coalesce(text, ''), ''), lambda x: case
    when ord(x) >= 128 then 27 + ord(x) % 37 when ord(lower(x)) between 97 and 122 then ord(lower(x)) - 96 else 0 end) as c from documents),
places as (select doc_id, lang, held_out, c[1:len(c) - 2] as x, c[2:len(c) - 1] as y, c[3:len(c)] as z from chars where len(c) >= 3),
grams as (select doc_id, lang, held_out, x * {langscore.CLASSES**2} + y * {langscore.CLASSES} + z as gram from (select doc_id, lang, held_out, unnest(x) as x, unnest(y) as y, unnest(z) as z from places) where y > 0),
learned as (select gram, count(*) filter (lang = 'en') as e, count(*) filter (lang <> 'en') as o from grams where not held_out and lang is not null group by 1),
known as (select count(*) filter (lang = 'en') as e, count(*) filter (lang <> 'en') as o from documents where doc_id % 5 <> 0 and lang is not null and text is not null),
whole as (select sum(e) + {langscore.SMOOTHING} * count(*) as e, sum(o) + {langscore.SMOOTHING} * count(*) as o from learned),
weights as (select gram, ln((l.e + {langscore.SMOOTHING}) / w.e) - ln((l.o + {langscore.SMOOTHING}) / w.o) as weight from learned l cross join whole w),
evidence as (select doc_id, sum(weight) as s, count(*) as n from grams join weights using (gram) group by 1),
e as (select doc_id, doc_id % 5 = 0 as held_out, round(case when n is null then 0.0::double else 1 / (1 + exp(-(s / n * least(n, {langscore.MOST_EVIDENCE}) + (select ln(e / o) from known)))) end, 6) as lang_score
  from documents left join evidence using (doc_id))"""


def english_model(spark, d: str) -> langscore.EnglishModel:
    """Learned from the languages of four fifths of the documents."""
    docs = table(spark, d, "documents")
    return langscore.train(docs.where("doc_id % 5 <> 0"), F.col("lang") == "en")


def with_english_score(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return scoring.with_english(docs, english_model(spark, d)).withColumn("lang_score", F.round("lang_score", 6))


@query(f"with {_ENGLISH} select doc_id, held_out, lang_score from e")
def english_score(spark, d):
    return with_english_score(spark, d).select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "lang_score")


@query(
    f"""with {_ENGLISH}, j as (select lang, lang = 'en' as y, lang_score >= 0.5 as p from e join documents using (doc_id) where held_out and lang is not null)
select lang, count(*) as n, count(*) filter (y = p) as n_right, count(*) filter (y = p) / count(*) as accuracy from j group by 1"""
)
def english_accuracy(spark, d):
    """Of texts that weren't learned from, how many are told right, by language."""
    rows = with_english_score(spark, d).where("doc_id % 5 = 0 and lang is not null")
    right = F.count(F.when((F.col("lang") == "en") == (F.col("lang_score") >= 0.5), 1))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), right.alias("n_right"), (right / F.count("*")).alias("accuracy"))


@query(f"with {_QUALITY}, {_ENGLISH} select doc_id, lang_score, quality_score from q join e using (doc_id) where lang_score >= 0.85 and quality_score >= 0.7")
def cascade_filter(spark, d):
    docs = scoring.with_quality(with_english_score(spark, d).withColumnRenamed("lang_score", "__english").select("doc_id", "text", "__english"), name="__quality")
    scores = scoring.cascade(docs, F.col("__english"), F.col("__quality"))
    return scoring.passes(scores).select("doc_id", "lang_score", "quality_score")


@query("select doc_id, s as sbert_score from (select doc_id, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' when doc_id % 5 = 2 then 'n/a' else cast((doc_id % 100) / 100.0 as varchar) end as s from documents) where coalesce(try_cast(s as double) >= 0.4, true)")
def threshold_tolerant(spark, d):
    m = F.col("doc_id") % 5
    hundredths = F.concat(F.lit("0."), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"))
    hundredths = F.when(F.col("doc_id") % 100 == 0, "0.0").otherwise(F.regexp_replace(hundredths, "0$", ""))
    s = F.when(m == 0, None).when(m == 1, "").when(m == 2, "n/a").otherwise(hundredths)
    return scoring.tolerant(table(spark, d, "documents").select("doc_id", s.alias("sbert_score")), {"sbert_score": 0.4, "nli_score": 0.0})


@query(f"with {SCORED} select doc_id, pos::integer as pos, target, sense_score from scored where sense_score >= {LEAST_SCORE} and year not in (2013) and target not in ('is')")
def sense_filter(spark, d):
    return scoring.counted(scored(spark, d), LEAST_SCORE, ("is",), (2013,)).select("doc_id", "pos", "target", "sense_score")


SENSE_TARGETS = ["the", "la", "und", "der", "of"]


def labelled_contexts(spark, d: str, held_out: bool) -> DataFrame:
    """Contexts of target words with their document's label: what a sense model learns from, or is judged by."""
    known = table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    docs = corpus(spark, d).where((F.col("doc_id") % 5 == 0) == held_out).join(known, "doc_id")
    return kwic(docs, SENSE_TARGETS, 10, ("doc_id", "label"))


_MARGIN = f"""with {KEYS},
spots as (select doc_id, pieces, pos, key as target from keys where key in ({quoted(SENSE_TARGETS)})),
ctx as (select doc_id, pos, target, quality as label, {_RTRIM % "pieces[greatest(pos - 10, 0) + 1:pos + 11]"} as context from spots join labels using (doc_id) where quality is not null),
feat as (select label, unnest(list_distinct(list_transform(regexp_extract_all(context, '[^{WS}]+'), lambda x: cast('0x' || left(md5(x), 6) as integer) % {sensemodel.BUCKETS}))) as bucket from ctx where doc_id % 5 <> 0)"""


@query(f"{_MARGIN} select cast(bucket as integer) as bucket, count(*) as n, cast(sum(label) as bigint) as n_1, true as at_optimum from feat group by 1")
def sense_fit(spark, d):
    """A fitted model: rows by bucket, and whether the objective's slope is zero in each."""
    known = stored(sensemodel.learnable(labelled_contexts(spark, d, False), "target_context"))
    model = sensemodel.fit(known)
    return sensemodel.slopes(known, model).select("bucket", "n", "n_1", (F.abs("slope") < 1e-8).alias("at_optimum"))


@query()
def sense_metrics(spark, d):
    """Confusion of a fitted model on contexts of documents that it hasn't learned from, in all and by target."""
    model = sensemodel.train(labelled_contexts(spark, d, False), "target_context")
    return annotation.confusion(labelled_contexts(spark, d, True).withColumn("p", model.probability("target_context")), F.col("label"), F.col("p") >= 0.5, "target")


@query(f"with {SCORED} select doc_id, pos::integer as pos, target, case when target in ('haha', 'hahaha') then 1.0::double else sense_score end as sense_score from scored where sense_score is null or target in ('haha', 'hahaha') or sense_score >= 0.9")
def sense_bypass(spark, d):
    rows = scored(spark, d).withColumn("sense_score", F.when(F.col("target").isin("haha", "hahaha"), 1.0).otherwise(F.col("sense_score")))
    blank = pseudo_score(F.col("doc_id"), F.col("pos")).isNull()
    return scoring.sense_filter(rows.where(~blank | F.col("sense_score").isNull() | F.col("target").isin("haha", "hahaha")), 0.9).select("doc_id", "pos", "target", "sense_score")


def _prompt_length_model(batches):
    """A stand-in for a sense model that can be told in SQL: a probability from a prompt's length."""
    for prompts in batches:
        yield (prompts.str.len() % 101) / 100.0


_CONTEXTS = f"{HITS.replace('pos, key as target from keys', 'pos, key as target, pieces from keys')}, ctx as (select doc_id, pos, target, {_RTRIM % 'pieces[greatest(pos - 5, 0) + 1:pos + 6]'} as target_context from hits)"


@query(
    f"""with {_CONTEXTS},
g as (select target, sum(case when length(trim(regexp_replace(target_context, '[{WS}]+', ' ', 'g'), ' ')) between 40 and 600 then 1 else 0 end) as usable from ctx where target <> 'haha' group by 1),
s as (select doc_id, pos, target, coalesce(usable < 3000, false) as rare, case when target = 'haha' then 1.0::double when usable < 3000 then null else round(2 * (length('Is ' || target || ' slang in: ' || target_context) % 101) / 100.0::double - 1, 4) end as sense_score from ctx left join g using (target))
select doc_id, cast(pos as integer) as pos, target, rare, sense_score from s where sense_score is null or sense_score >= 0.5"""
)
def sense_scored(spark, d):
    """Always-slang targets, rare groups and the model in one pass over the contexts."""
    rows = kwic(corpus(spark, d), SINGLES, 5, ("doc_id",))
    prompt = scoring.prompt("Is {target} slang in: {context}", F.col("target"), F.col("target_context"))
    out = scoring.sense_filter(scoring.sense_scored(rows, _prompt_length_model, prompt, ("haha",), least=3000), 0.5)
    return out.select("doc_id", "pos", "target", "rare", "sense_score")


@query("select lang, count(*) filter (contains(text, ' the ')) as holds, count(*) as n from documents group by 1")
def substring_flag(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.when(T.holds("text", " the "), 1)).alias("holds"), F.count("*").alias("n"))


@query(
    f"""with {HITS.replace('pos, key as target from keys', 'pos, key as target, pieces from keys')}, c as (select doc_id, pos, target, trim(regexp_replace({_RTRIM % 'pieces[greatest(pos - 20, 0) + 1:pos + 21]'}, '[{WS}]+', ' ', 'g'), ' ') as cl from hits),
g as (select target, cast(sum(case when length(cl) between 40 and 600 then 1 else 0 end) as bigint) as usable from c group by 1) select target as group_key, usable, usable < 50 as rare from g"""
)
def rare_groups(spark, d):
    return scoring.rare_groups(kwic(corpus(spark, d), SINGLES, 20, ("doc_id",))).select("group_key", "usable", "rare").distinct()


@query(f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''’‘ʼ]', '', 'g'), '\\p{{P}}', ' ', 'g'), '[{WS}]+', ' ', 'g'), ' ') as group_key from documents")
def group_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.group_key("text").alias("group_key"))


@query(
    f"""with t as (select doc_id, text, 'd' as kind from documents union all select item_id, text, 'b' from benchmark),
c as (select doc_id, kind, trim(regexp_replace(text, '[{WS}]+', ' ', 'g'), ' ') as clean from t where text is not null)
select md5(lower(clean)) as clean_md5, min(doc_id) as doc_id, count(*) as copies from c where kind = 'd' and length(clean) between 40 and 3000 and lower(clean) not in (select lower(clean) from c where kind = 'b') group by 1"""
)
def exclude_contexts(spark, d):
    """Texts of a fit length that are no benchmark text, grouped by a hash of the clean text."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("target_context"))
    kept = annotation.usable_contexts(rows, table(spark, d, "benchmark"), 40, 3000)
    return kept.groupBy(F.md5(F.lower("clean")).alias("clean_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"with {CORPUS} select dump, doc_id from (select dump, doc_id, row_number() over (partition by dump order by {_chance('doc_id', 7)}, doc_id) as r from corpus) where r <= 10")
def reservoir_docs(spark, d):
    """Ten documents of each crawl."""
    return sampling.sample_by(corpus(spark, d).select("dump", "doc_id"), "dump", 10, "doc_id", seed=7)


@query(
    f"""with {CORPUS}, p as (select dump from (select distinct dump from corpus) order by {_chance('dump', 7)}, dump limit 6),
i as (select dump, doc_id, row_number() over (partition by dump order by {_chance('doc_id', 7)}, doc_id) as r from corpus where dump in (select dump from p))
select dump, doc_id from i where r <= 10 order by {_chance('doc_id', 8)}, doc_id limit 60"""
)
def two_stage_sample(spark, d):
    """Sixty documents of six crawls."""
    return sampling.two_stage(corpus(spark, d).select("dump", "doc_id"), "dump", 60, 6, "doc_id", seed=7)


@query(
    f"""with {CORPUS}, w as (select dump, doc_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z''-]+'), lambda x: lower(x)), lambda x: length(x) >= 3) as ws from corpus),
t as (select dump, doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from w)
select dump, doc_id, cast(pos as integer) as pos, word from (select *, row_number() over (partition by dump order by {_chance('doc_id, pos', 3)}, doc_id, pos) as r from t) where r <= 20"""
)
def token_sample(spark, d):
    """Twenty tokens of each crawl, with their places."""
    return sampling.sample_tokens(corpus(spark, d), "dump", T.sampler_tokens("text"), 20, "doc_id", seed=3).withColumnRenamed("at", "pos")


@query("select source, count(*) as n, (sum(doc_id) * 0 + 1000003 * 7 + min(cast(substr(source, 4) as integer))) & 2147483647 as seed from documents group by 1")
def crawl_seeds(spark, d):
    i = F.min(F.substring("source", 4, 9).cast("int"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), sampling.crawl_seed(7, i).alias("seed"))


@query(f"with {HITS} select target, count(*) as total from hits group by 1 order by total desc, target limit 5")
def top_words(spark, d):
    t = totals(spark, d).where("target is not null").select("dump", "target", F.col("n").alias("hits"))
    return rates.top_words(t, 5)


@query(f"with {RATES}, p as (select target, max(case when year = 2013 then rate end) as rate_first, max(case when year = 2024 then rate end) as rate_last from rates group by 1) select *, log2(rate_last / rate_first) as log2_ratio from p where rate_first > 0 and rate_last > 0")
def log_ratio(spark, d):
    return rates.log_ratio(year_rates(spark, d), 2013, 2024)


@query(f"with {RATES} select target, count(*) as periods, avg(rate) as mean_rate, log2(max(rate) / min(rate)) as variation from rates where rate > 0 group by 1 having count(*) >= 5 and avg(rate) >= 20")
def variation(spark, d):
    return rates.variation(year_rates(spark, d))


@query(f"with {HITS} select year, target, count(*) as hits from hits group by 1, 2")
def pooled_counts(spark, d):
    # two runs, over English texts and over the rest
    h = kwic(corpus(spark, d), SINGLES, 0, ("year", "lang"), context=False)
    return rates.pooled(rates.counts_by(h.where("lang = 'en'"), "year"), rates.counts_by(h.where("lang <> 'en' or lang is null"), "year"))


@query(f"with {PEAKS} select target, peak_year, case when peak_year <= 2017 then '<=2017' when peak_year <= 2021 then '2018-2021' else '>2021' end as cohort from peaks")
def cohorts(spark, d):
    return rates.peaks(year_rates(spark, d)).select("target", "peak_year", rates.cohort(F.col("peak_year")).alias("cohort"))


@query(
    f"""with a as (select key as word, count(*) as n from (select role, lower(trim(regexp_replace(u, '[{WS}]+$', ''), '{T.PUNCTUATION.replace("'", "''")}')) as key
  from (select role, unnest(regexp_extract_all(text, '[^{WS}]+[{WS}]*')) as u from conversations where text is not null)) where key in ({quoted(SINGLES)}) group by 1),
r as (select word, n, row_number() over (order by n desc, word) as rank from a) select word, n, rank::integer as rank, cast((rank - 1) // 20 as bigint) as grp from r"""
)
def ranked_groups(spark, d):
    """Words by their total over all models, in groups of twenty."""
    said = count_targets(table(spark, d, "conversations"), SINGLES, ("role",)).where("target is not null").select(F.col("role").alias("model"), F.col("target").alias("word"), "n")
    return rates.ranked_totals(said)


@query(rf"with {HITS}, c as (select doc_id from corpus where regexp_matches(text, '(?i)(?:^|\s)[[:punct:]]*(?:haha|la)[[:punct:]]*(?:\s|$)')) select (select count(*) from corpus) as docs, (select count(*) from c) as candidates, (select count(*) from hits where target in ('haha', 'la')) as contexts, (select count(distinct target) from hits where target in ('haha', 'la')) as targets")
def run_summary(spark, d):
    """Counters of an extraction: documents, those that may match, contexts and targets found."""
    words = ["haha", "la"]
    c = corpus(spark, d)
    docs = c.agg(F.count("*").alias("docs"), F.count(F.when(F.col("text").rlike(prefilter_pattern(words)), 1)).alias("candidates"))
    found = kwic(c, words, 5, ("doc_id",)).agg(F.count("*").alias("contexts"), F.countDistinct("target").alias("targets"))
    return docs.join(F.broadcast(found))  # a row each


@query(
    """with w as (select doc_id, quality, toxic from labels), s as (select 'all' as slice, quality as t, toxic as p from w union all select 'quality=' || quality, quality, toxic from w),
c as (select slice, cast(sum(case when t = 1 and p = 1 then 1 else 0 end) as bigint) as tp, cast(sum(case when t = 0 and p = 1 then 1 else 0 end) as bigint) as fp, cast(sum(case when t = 1 and p = 0 then 1 else 0 end) as bigint) as fn, cast(sum(case when t = 0 and p = 0 then 1 else 0 end) as bigint) as tn from s group by 1),
m as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0::double) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0::double) as recall from c)
select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0::double) as f1, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0::double) as accuracy, coalesce(fp / nullif(fp + tn, 0), 0.0::double) as fpr, coalesce(fn / nullif(fn + tp, 0), 0.0::double) as fnr from m"""
)
def confusion_metrics(spark, d):
    return annotation.confusion(table(spark, d, "labels"), F.col("quality"), F.col("toxic"), "quality")


@query("with b as (select source, sum(case when toxic = 1 then 1 else 0 end)::bigint as n1, sum(case when toxic = 0 then 1 else 0 end)::bigint as n0 from labels join documents using (doc_id) group by 1) select *, case when abs(n1 - n0) > 10 then case when n1 < n0 then 1 else 0 end else -1 end as add_label, case when abs(n1 - n0) > 10 then abs(n1 - n0) else 0 end::bigint as add_n from b")
def label_balance(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return annotation.balance(j, "source", "toxic", 10)


@query("select 1.0::double as weight_0, sum(case when toxic = 0 then 1 else 0 end)::bigint / greatest(sum(case when toxic = 1 then 1 else 0 end)::bigint, 1) as weight_1 from labels")
def class_weights(spark, d):
    return annotation.class_weights(table(spark, d, "labels"), "toxic")


@query(f"select doc_id, toxic as label, row_number() over (partition by toxic order by {_chance('doc_id', 42)}, doc_id) <= round(count(*) over (partition by toxic) * 0.8::double) as is_train from labels")
def stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "labels"), "toxic", 0.8, "doc_id").select("doc_id", F.col("toxic").alias("label"), "is_train")


@query(f"with {CORPUS} select doc_id, dump from corpus where doc_id not in (select doc_id from labels)")
def anti_join_unscored(spark, d):
    from driftlex.sources.files import remaining

    return remaining(corpus(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id", "dump")


@query(
    f"""with {CORPUS}, h as (select dump, count(*) as have from corpus where doc_id in (select doc_id from labels) group by 1),
f as (select c.dump, doc_id, have, row_number() over (partition by c.dump order by {_chance('doc_id', 1 ^ 0x5A5A5A5A)}, doc_id) as r from corpus c left join h using (dump) where doc_id not in (select doc_id from labels))
select dump, doc_id from f where r <= 400 - coalesce(have, 0)"""
)
def topup_resume(spark, d):
    c = corpus(spark, d).select("dump", "doc_id")
    return sampling.top_up(c, c.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), "dump", 400, "doc_id", seed=1).select("dump", "doc_id")


@query(f"with {PEAKS}, c as (select target as word, sum(hits) as n from rates group by 1) select cast(sum(n * peak_year) as bigint) / cast(sum(n) as bigint) as vintage, cast(sum(n) as bigint) as hits, count(*) as words from c join peaks on word = target where n > 0")
def vintage(spark, d):
    p = rates.peaks(year_rates(spark, d)).withColumnRenamed("target", "word")
    return S.vintage(p.select("word", F.col("total_hits").alias("n")), p)


def mixture_cells(spark, d):
    """Years and packed rows: how often each role says a target word, with the word's smoothed share in each year."""
    shares = S.smoothed_matrix(year_rates(spark, d)).select("year", F.col("target").alias("word"), "p")
    said = table(spark, d, "conversations").select(F.col("role").alias("fit"), F.explode(T.keys("text")).alias("word")).where(F.col("word").isin(SINGLES)).groupBy("fit", "word").agg(F.count("*").alias("n"))
    years, cells = mixtures.packed(shares, said)
    return years, stored(cells)


# expectation maximisation by recursion: each fit is a row with its words and weights, each step a function of them
_EM = f"""with recursive {RATES},
said as (select role as fit, key as word, count(*) as n from (select role, lower(trim(regexp_replace(u, '[{WS}]+$', ''), '{T.PUNCTUATION.replace("'", "''")}')) as key
  from (select role, unnest(regexp_extract_all(text, '[^{WS}]+[{WS}]*')) as u from conversations where text is not null)) where key in ({quoted(SINGLES)}) group by 1, 2),
shares as (select year, target as word, (hits + 0.5) / sum(hits + 0.5) over (partition by year) as p from rates),
byword as (select word, list(cast(p as double) order by year) as p from shares group by 1),
cells as (select f.fit, b.word, coalesce(s.n, 0) / sum(coalesce(s.n, 0)) over (partition by f.fit) as q, b.p from (select distinct fit from said where word in (select word from byword)) f cross join byword b left join said s on s.fit = f.fit and s.word = b.word),
packs as (select fit, list({{'q': cast(q as double), 'p': p}} order by word) as m, len(any_value(p)) as k from cells group by 1),
em as (
  select 0 as i, fit, m, list_transform(range(k), lambda y: 1.0::double / k) as w, false as settled from packs
  union all
  select i + 1, fit, m, v, list_max(list_transform(v, lambda x, y: abs(x - w[y]))) < 1e-10
  from (select i, fit, m, w, list_transform(u, lambda x: x / list_sum(u)) as v
    from (select i, fit, m, w, list_transform(w, lambda x, y: x * list_sum(list_transform(r, lambda z, j: z * m[j].p[y]))) as u
      from (select i, fit, m, w, list_transform(m, lambda c: c.q / list_dot_product(c.p, w)) as r from em where not settled and i < 2000)))),
last as (select fit, w from (select fit, w, row_number() over (partition by fit order by i desc) as rn from em) where rn = 1)"""


@query(f"{_EM} select fit as model, y.year, round(w[y.at], 6) as weight from last cross join (select year, row_number() over (order by year) as at from (select distinct year from rates)) y".replace("y.at", "y.nth").replace("as at from", "as nth from"))
def mixture_em(spark, d):
    """Weights of the years whose mixture is nearest to what each role says, in relative entropy."""
    years, cells = mixture_cells(spark, d)
    return mixtures.weights(years, cells).select(F.col("fit").alias("model"), "year", F.round("weight", 6).alias("weight"))


@query(
    f"""{_EM}, mixed as (select c.fit, word, q, list_dot_product(p, w) as mix, list_avg(p) as flat from cells c join last using (fit))
select fit as model, round(sum(case when q > 0 then q * ln(q / mix) else 0 end), 6) as divergence, round(sum(case when q > 0 then q * ln(q / flat) else 0 end), 6) as null_divergence,
  (select round(sum(x.w * x.year), 4) from (select unnest(l.w) as w, unnest((select list(year order by year) from (select distinct year from rates))) as year from last l where l.fit = mixed.fit) x) as vintage
from mixed group by fit"""
)
def mixture_fit(spark, d):
    """How near the mixture of each role comes, against equal weights, and its mean year."""
    years, cells = mixture_cells(spark, d)
    fitted = stored(mixtures.weights(years, cells))
    near = mixtures.divergence(mixtures.mixture_of(years, cells, fitted))
    null = mixtures.divergence(mixtures.mixture_of(years, cells, mixtures.uniform(fitted))).withColumnRenamed("divergence", "null_divergence")
    out = near.join(null, "fit").join(mixtures.vintages(fitted), "fit")
    return out.select(F.col("fit").alias("model"), F.round("divergence", 6).alias("divergence"), F.round("null_divergence", 6).alias("null_divergence"), F.round("vintage", 4).alias("vintage"))


@query(
    f"""{_EM}, mixed as (select c.fit, word, q, list_dot_product(p, w) as mix from cells c join last using (fit) where q > 0)
select fit as model, word, round(q, 6) as p_model, round(mix, 6) as p_mix, round(q / mix, 4) as ratio, case when q / mix > 3 then 1 when q / mix < 0.33 then -1 else 0 end as flag from mixed"""
)
def mixture_words(spark, d):
    """Each word's share of what a role says against the fitted mixture's, flagged if more than three times off."""
    years, cells = mixture_cells(spark, d)
    f = mixtures.word_fit(mixtures.mixture_of(years, cells, mixtures.weights(years, cells)))
    return f.select(F.col("fit").alias("model"), "word", F.round("p_model", 6).alias("p_model"), F.round("p_mix", 6).alias("p_mix"), F.round("ratio", 4).alias("ratio"), "flag")


@query()
def mixture_l2(spark, d):
    """Weights of the years whose mixture is nearest to what each role says, by least squares."""
    years, cells = mixture_cells(spark, d)
    return mixtures.weights(years, cells, "l2").withColumnRenamed("fit", "model")


@query()
def mixture_interval(spark, d):
    """Intervals of the mixture's weights and of its vintage (a null year), refitted to 200 draws of the counts."""
    years, cells = mixture_cells(spark, d)
    return mixtures.intervals(years, cells, 200).withColumnRenamed("fit", "model")


@query(
    f"""with {PEAKS}, p as (select cast(sum(total_hits * peak_year) as double) / sum(total_hits) as point, cast(sum(total_hits) as double) as total from peaks)
select 2000 as replicates, round(min(point), 6) as vintage, round(sqrt(sum(total_hits * (peak_year - point) * (peak_year - point))) / min(total), 6) as se, true as around, true as as_wide_as_theory from peaks cross join p"""
)
def bootstrap_vintage(spark, d):
    """The vintage, its standard error by the delta method, and whether the resampled interval lies about it and is as wide."""
    import numpy as np

    rows = rates.peaks(year_rates(spark, d)).select("peak_year", "total_hits").collect()  # a row for each target word
    years, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    point = float(n @ years / n.sum())
    se = float(np.sqrt((n * (years - point) ** 2).sum()) / n.sum())
    b = S.poisson_bootstrap(spark, n, lambda x: float(x @ years / x.sum()), 2000)
    width = (F.col("high") - F.col("low")) / (2 * 1.959964 * se)
    told = [F.lit(round(point, 6)).alias("vintage"), F.lit(round(se, 6)).alias("se")]
    return b.select(F.col("replicates").cast("int").alias("replicates"), *told, ((F.col("low") <= point) & (F.col("high") >= point)).alias("around"), width.between(0.9, 1.1).alias("as_wide_as_theory"))


@query(
    f"""with {PEAKS}, a as (select key as word, count(*) as n, role from (select role, lower(trim(regexp_replace(u, '[{WS}]+$', ''), '{T.PUNCTUATION.replace("'", "''")}')) as key from (select role, unnest(regexp_extract_all(text, '[^{WS}]+[{WS}]*')) as u from conversations where text is not null)) where key in ({quoted(SINGLES)}) group by 1, 3),
c as (select cast(sum(total_hits * peak_year) as bigint) / cast(sum(total_hits) as bigint) as corpus_vintage from peaks)
select role as model, sum(n * peak_year)::bigint / sum(n)::bigint as vintage, sum(n)::bigint as hits, count(*) as words, corpus_vintage, sum(n * peak_year)::bigint / sum(n)::bigint - corpus_vintage as lag from a join peaks on word = target cross join c group by role, corpus_vintage"""
)
def vintage_lag(spark, d):
    p = rates.peaks(year_rates(spark, d)).withColumnRenamed("target", "word")
    said = table(spark, d, "conversations").select(F.col("role").alias("model"), F.explode(T.keys("text")).alias("word")).where(F.col("word").isin(SINGLES)).groupBy("model", "word").agg(F.count("*").alias("n"))
    return S.vintage_lags(said, p.select("word", F.col("total_hits").alias("n")), p, "model")


@query(f"with {PEAKS}, t as (select sum(total_hits)::bigint as total from peaks) select target as word, total_hits::bigint as n, peak_year, total_hits::bigint / total as weight, total_hits::bigint / total * peak_year as contribution from peaks cross join t where total_hits > 0")
def vintage_words(spark, d):
    p = rates.peaks(year_rates(spark, d)).withColumnRenamed("target", "word")
    return S.contributions(p.select("word", F.col("total_hits").alias("n")), p)


@query(f"with {KEYS} select d.lang, key as target, count(*) as n from keys k join documents d using (doc_id) where key in ({quoted(SINGLES)}) group by 1, 2")
def raw_word_count(spark, d):
    return count_targets(corpus(spark, d), SINGLES, ("lang",)).where("target is not null")


@query(f"with {HITS} select dump, count(*) as hits from hits where target in ('the', 'of', 'la') group by 1")
def aggregate_series(spark, d):
    t = totals(spark, d).where(F.col("target").isin("the", "of", "la"))
    return t.groupBy("dump").agg(F.sum("n").alias("hits"))


@query(
    f"""with {HITS.replace('pos, key as target from keys', 'pos, key as target, pieces from keys')},
c as (select doc_id, pos, target, trim(regexp_replace({_RTRIM % 'pieces[greatest(pos - 20, 0) + 1:pos + 21]'}, '[{WS}]+', ' ', 'g'), ' ') as clean from hits where target in ('haha', 'hahaha', 'und')),
u as (select *, {_chance("doc_id, pos", 0)} as h from c where length(clean) between 40 and 600
  and md5(lower(clean)) not in (select md5(lower(trim(regexp_replace(text, '[{WS}]+', ' ', 'g'), ' '))) from benchmark where text is not null)),
p as (select * from (select *, row_number() over (partition by target order by h, doc_id, pos) as r from u) where r <= 400),
o as (select * from (select *, row_number() over (partition by target, lower(clean) order by h, doc_id, pos) as k from p) where k = 1)
select target as group_key, doc_id, cast(pos as integer) as pos, md5(clean) as clean_md5 from (select *, row_number() over (partition by target order by h, doc_id, pos) as n from o) where n <= 25"""
)
def annotation_pool(spark, d):
    """At most 25 contexts of each group, each text once, of a fit length."""
    rows = kwic(corpus(spark, d), ["haha", "hahaha", "und"], 20, ("doc_id", "uri"))
    usable = annotation.usable_contexts(rows, table(spark, d, "benchmark"))
    return annotation.annotation_batch(usable, 25, "doc_id", "pos").select("group_key", "doc_id", "pos", F.md5("clean").alias("clean_md5"))


@query(
    f"""with l as (select d.lang, l.toxic as label, doc_id from labels l join documents d using (doc_id) where l.toxic is not null and d.lang is not null)
select lang, label, doc_id from (select *, row_number() over (partition by lang, label order by {_chance('doc_id', 0)}, doc_id) as r from l) where r <= 5"""
)
def reference_examples(spark, d):
    labelled = corpus(spark, d).select("doc_id", "lang", "uri").join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return annotation.reference_examples(annotation.valid_labels(labelled).where("lang is not null"), "lang", 5, "doc_id").select("lang", "label", "doc_id")
