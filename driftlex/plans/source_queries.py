"""Sources and sinks: tables written as each kind of file into the shared folder and read back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from driftlex.functions import dumps as D
from driftlex.functions import text as T
from driftlex.operators import prompts, responses, sampling
from driftlex.operators.kwic import kwic, read_targets
from driftlex.plans.base import CORPUS, HITS, WS, corpus, query, table
from driftlex.plans.corpus_queries import _chance
from driftlex.sources import files, warc
from driftlex.sources.shared import new_folder
from driftlex.streaming import ingest


#: Most rows of a file that arrives, and batches that all of them come in.
FILE_ROWS, BATCHES = 5_000, 3


@query(f"with {CORPUS} select doc_id, dump, uri, md5(text) as text_md5 from corpus")
def corpus_scan(spark, d):
    """The columns that a trend needs, out of a table of Parquet."""
    path = new_folder(spark, "corpus")
    corpus(spark, d).write.parquet(path)
    return files.read_corpus(spark, path, "doc_id", "dump", "uri", "text").select("doc_id", "dump", "uri", F.md5("text").alias("text_md5"))


@query(f"with {CORPUS} select dump, count(*) as n, sum(length(text))::bigint as chars from corpus group by 1")
def dump_sink(spark, d):
    """A folder for each crawl."""
    path = new_folder(spark, "dumps")
    files.write_by_dump(corpus(spark, d).select("dump", "doc_id", "text"), path)
    return spark.read.parquet(path).groupBy(F.col("dump").cast("string").alias("dump")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"with {CORPUS} select dump, count(*) as n, sum(doc_id)::bigint as ids, count(distinct md5(text)) as texts from corpus where text is not null group by 1")
def merged_shards(spark, d):
    """Shards of each crawl as CSV in a folder of its name."""
    shards, merged = new_folder(spark, "shards"), new_folder(spark, "merged")
    files.write_by_dump(corpus(spark, d).where("text is not null").select("dump", "doc_id", "text"), shards)
    files.merge_shards(spark, shards, merged, delete=True)
    back = files.read_csv(spark, merged)
    return back.groupBy("dump").agg(F.count("*").alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"), F.countDistinct(F.md5("text")).alias("texts"))


@query("select conv_id, turn, role, md5(text) as text_md5 from conversations where text <> ''")
def csv_round_trip(spark, d):
    """Cells with quotes, commas and line breaks through CSV."""
    path = new_folder(spark, "csv")
    files.write_csv(table(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", "role", "text"), path)
    return files.read_csv(spark, path).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5("text").alias("text_md5"))


@query("select distinct 'https://data.example.org/' || 'crawl/' || source || '.warc.gz' as path from documents where source is not null")
def path_index(spark, d):
    """A gzipped list of paths, with comments and blank lines."""
    path = new_folder(spark, "paths")
    lines = table(spark, d, "documents").where("source is not null").select("source").distinct().select(F.explode(F.array(F.concat(F.lit(" crawl/"), "source", F.lit(".warc.gz ")), F.lit("# a comment"), F.lit(" "))).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return files.read_path_index(spark, path, "https://data.example.org/")


@query("select role as model, conv_id, turn, md5(text) as text_md5 from conversations where turn % 2 = 0 or conv_id % 3 <> 0")
def response_files(spark, d):
    """Two runs' responses as JSON lines by model; of a request that is in both the later one counts."""
    path = new_folder(spark, "responses")
    rows = table(spark, d, "conversations").select(F.col("role").alias("model"), F.col("conv_id").cast("string").alias("prompt_id"), F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("variables"), F.lit(0).alias("sample"), "conv_id", "turn", "text")
    files.write_responses(rows.where("turn % 2 = 0").withColumn("text", F.lit("old")), path, "20240101_000000")
    files.write_responses(rows.where("turn % 2 = 0 or conv_id % 3 <> 0"), path, "20240102_000000")
    schema = "model string, prompt_id string, variables map<string,string>, sample int, conv_id long, turn long, text string"
    back = spark.read.schema(schema + ", run string, model_file string").json(path)
    latest = responses.newest_of_files(back.withColumn("file", F.concat(F.lit("r_"), "run", F.lit(".jsonl"))).withColumn("modified", F.lit(0).cast("timestamp")).withColumn("__v", responses.canonical(F.col("variables"))), ["model", "prompt_id", "__v", "sample"], index="conv_id")
    return latest.select("model", "conv_id", "turn", F.md5("text").alias("text_md5"))


@query(f"with {CORPUS} select dump, sum(len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+')))::bigint as tokens from corpus group by 1")
def dump_sizes(spark, d):
    """A JSON object of token totals by crawl, written and read."""
    path = new_folder(spark, "sizes")
    totals = corpus(spark, d).groupBy("dump").agg(F.sum(T.n_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    whole = totals.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dump", "tokens")))).alias("value"))  # a number for each crawl
    whole.write.text(path)
    return files.read_json_map(spark, path)


@query("select word, cast(n as bigint) as count, cast(sum(n) over () as bigint) as total from (select lang as word, count(*) as n from documents where lang is not null group by 1)")
def word_counts_file(spark, d):
    """A count file without a number of tokens: its total is that of the occurrences."""
    path = new_folder(spark, "counts")
    n = table(spark, d, "documents").where("lang is not null").groupBy(F.col("lang").alias("word")).agg(F.count("*").alias("count"))
    n.agg(F.to_json(F.struct(F.sum("count").alias("total_word_occurrences"), F.lit(0).alias("total_corpus_tokens"), F.collect_list(F.struct("word", "count")).alias("words"))).alias("value")).write.text(path)
    return files.read_word_counts(spark, path)


@query("select distinct lower(trim(w, ' ')) as word from (select unnest([lang, source]) as w from documents) where trim(w, ' ') <> ''")
def word_list(spark, d):
    """A list of words with repeats, capitals, blanks and comments."""
    path = new_folder(spark, "words")
    words = table(spark, d, "documents").select(F.explode(F.array(F.lit("# list"), F.upper("lang"), F.concat(F.lit(" "), "source"), F.lit(""))).alias("value")).where("value is not null").distinct()
    words.coalesce(1).write.text(path)
    return files.read_words(spark, path).select("word")


@query("select url as uri, md5(html) as payload_md5 from pages")
def archive_records(spark, d):
    """Pages as gzipped archives and back, read in ranges of a megabyte."""
    path = new_folder(spark, "archives")
    warc.write_archives(table(spark, d, "pages"), path, F.col("url"), F.col("html"))
    return warc.read_archives(spark, path, 1 << 20).where("rec_type = 'response'").select("uri", F.md5("payload").alias("payload_md5"))


@query(f"with {CORPUS} select uri, md5(text) as text_md5 from corpus where trim(regexp_replace(text, '[{WS}]+', ' ', 'g'), ' ') <> ''")
def archive_texts(spark, d):
    """Extracted texts of an archive that aren't blank."""
    path = new_folder(spark, "texts")
    warc.write_archives(corpus(spark, d).where("text is not null"), path, F.col("uri"), F.col("text"), kind="conversion", content_type="text/plain")
    return warc.english_text(warc.read_archives(spark, path, 4 << 20)).select("uri", F.md5("payload").alias("text_md5"))


@query(f"with {HITS} select doc_id, cast(pos as integer) as pos, target from hits where target in ('the', 'of')")
def shadowed_targets(spark, d):
    """Words that are listed before phrases which begin with them hide these."""
    return kwic(corpus(spark, d), read_targets(["# words", "The", "the and", "of", "of the", ""]), 0, ("doc_id",), context=False)


@query(f"with {CORPUS}, m as (select *, cast(date_trunc('week', make_date(year, 1, 4)) as date) + cast(7 * (cast(right(dump, 2) as integer) - 1) as integer) as day from corpus) select doc_id, dump from m where day between date '2014-01-01' and date '2019-06-30'")
def date_filter(spark, d):
    """Documents of crawls whose Monday lies between two days."""
    return corpus(spark, d).where(D.in_dates(F.col("dump"), "2014-01-01", "2019-06-30")).select("doc_id", "dump")


@query(f"with n as (select *, count(*) over (partition by lang) as m, row_number() over (partition by lang order by {_chance('doc_id', 0)}, doc_id) as r from documents) select lang, doc_id from n where m >= 50 and r <= 50")
def fixed_sample(spark, d):
    """Fifty documents of each language that has as many."""
    return sampling.fixed(table(spark, d, "documents").where("lang is not null").select("lang", "doc_id"), "lang", 50, "doc_id")


@query(
    """with w as (select conv_id, turn, list_transform(string_split(text, ' '), lambda x, i: case when i = 1 then x else ' ' || x end) as ts from conversations where text is not null),
p as (select conv_id, turn, ts, len(list_filter(range(1, len(ts) + 1), lambda i: len(list_filter(ts[1:i], lambda x: regexp_matches(x, '[\\s.!?,]'))) = 0)) as n from w)
select conv_id, turn, cast(n as integer) as n, array_to_string(ts[1:n], '') as answer from p"""
)
def strict_answers(spark, d):
    """Answers up to the first token with white space or a stop sign."""
    w = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", " ").alias("w"))
    tokens = w.withColumn("tokens", F.transform("w", lambda x, i: F.struct(F.when(i == 0, x).otherwise(F.concat(F.lit(" "), x)).alias("token"), F.lit(-0.1).alias("logprob"))))
    n = tokens.withColumn("n", responses.strict_answer_length(F.col("tokens")))
    return n.select("conv_id", "turn", "n", responses.joined_tokens(F.col("tokens"), F.col("n")).alias("answer"))


@query("select conv_id, turn from conversations where role = 'assistant'")
def picked_model(spark, d):
    """Records of the one model whose name holds a part."""
    t = table(spark, d, "conversations").withColumnRenamed("role", "model")
    return t.where(F.col("model") == prompts.pick_model(t, "ASSIST")).select("conv_id", "turn")


@query(f"with {HITS} select doc_id, dump, cast(pos as integer) as pos, target from hits where target in ('the', 'la')")
def stream_contexts(spark, d):
    """Contexts by an incremental run over files that arrived."""
    arrived, out, state = new_folder(spark, "arrived"), new_folder(spark, "contexts"), new_folder(spark, "state")
    corpus(spark, d).select("doc_id", "text", "dump").write.parquet(arrived)
    docs = ingest.arrivals(spark, arrived, "doc_id long, text string, dump string")
    ingest.stream_contexts(docs, ["the", "la"], out, state).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.col("dump").cast("string").alias("dump"), "pos", "target")


@query(f"with {HITS} select dump, target, count(*) as hits from hits where target in ('the', 'la') group by 1, 2")
def stream_counts(spark, d):
    """Running counts by an incremental run, one version a batch."""
    arrived, counts, state = new_folder(spark, "arrived"), new_folder(spark, "running"), new_folder(spark, "state")
    # several files of a bounded number of rows from each part of the input, in a few batches however many there are
    corpus(spark, d).select("doc_id", "text", "dump").write.option("maxRecordsPerFile", FILE_ROWS).parquet(arrived)
    files_per_batch = max(1, math.ceil(len(spark.read.parquet(arrived).inputFiles()) / BATCHES))
    docs = ingest.arrivals(spark, arrived, "doc_id long, text string, dump string", files_per_batch)
    ingest.stream_counts(docs, ["the", "la"], counts, state).awaitTermination()
    return ingest.current_counts(spark, counts)
