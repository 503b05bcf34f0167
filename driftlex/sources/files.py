"""Sources and sinks: partitioned Parquet, CSV, concatenated JSON, JSON maps, word lists, resume."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlex.operators import responses
from driftlex.sources import jsonparts


def read_corpus(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Column-pruned Parquet scan; splits of files are dealt by Spark."""
    return spark.read.parquet(path).select(*(columns or ("text", "url", "dump")))


def write_by_dump(rows: DataFrame, path: str) -> None:
    """One folder for each crawl, zstd; rows of a crawl meet in few tasks, and a large crawl is cut into several files."""
    rows.hint("rebalance", "dump").write.mode("overwrite").partitionBy("dump").option("compression", "zstd").parquet(path)


def write_csv(rows: DataFrame, path: str, by: str | None = None, one_file: bool = False) -> None:
    """CSV with header: many files, one in all, or a folder for each group. Cells keep the blanks at their ends; an empty one is quoted, a null isn't."""
    w = (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (w.partitionBy(by) if by else w).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of strings: quoted line breaks and doubled quotes, any cell length, header cleared of BOM and quotes.

    A cell without anything is null, one of two quotes an empty string.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
    # by default a quoted empty cell is null too, and a zero byte beside a quote is taken for a sign that escapes it
    r = r.option("nullValue", f"null-{uuid.uuid4().hex}").option("charToEscapeQuoteEscaping", '"')
    df = r.csv(path)
    return df.toDF(*[c.lstrip("﻿").strip("\"' ") for c in df.columns])


def merge_shards(spark: SparkSession, path: str, out: str, delete: bool = False) -> None:
    """Shards of a crawl as CSV in a folder of its name: one file, or for a large crawl several; the committer makes all whole or none.

    With ``delete`` the shards go, once the files are there.
    """
    rows = spark.read.parquet(path)
    write_csv(rows.hint("rebalance", "dump"), out, by="dump")
    if delete:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def expand_inputs(spark: SparkSession, *patterns: str) -> list[str]:
    """Paths that patterns name, each pattern's in order; a folder's files; a pattern that fits nothing stays as it is. Each path once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, None] = {}
    for pattern in patterns:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = p.getFileSystem(conf)
        found = [(f.getPath(), f.isDirectory()) for f in fs.globStatus(p) or []]
        inside = lambda at, fs=fs: [f.getPath().toString() for f in fs.listStatus(at) if not f.isDirectory() and not f.getPath().getName().startswith((".", "_"))]
        names = sorted(x for at, folder in found for x in (inside(at) if folder else [at.toString()]))
        out |= dict.fromkeys(names or [pattern])
    return list(out)


def file_name() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z0-9]+$", "")


def read_json_objects(spark: SparkSession, path: str, schema: str, required: str | None = None, strict: bool = False) -> DataFrame:
    """Records of files of objects one after another, compact or pretty-printed: ``file, modified, index`` and the fields.

    A truncated last record is left out, or an error if ``strict``; rows without ``required`` are left out.
    Large files are read in ranges.
    """
    values = jsonparts.file_values(spark, path, strict)
    each = values.select("file", "modified", "index", F.from_json("json", schema).alias("r")).where("r is not null").select("file", "modified", "index", "r.*")
    return each if required is None else each.where(F.col(required).isNotNull())


def read_responses(spark: SparkSession, path: str, schema: str, latest_only: bool = True) -> DataFrame:
    """Response records of a file, or of all ``*.jsonl`` files of a folder; of repeated ones that of the newest file.

    Records are the same if model, prompt, variables (whatever their order) and sample are.
    """
    one_file = path.endswith(".jsonl")
    rows = read_json_objects(spark, path if one_file else f"{path}/*.jsonl", schema)
    if one_file or not latest_only:
        return rows
    keyed = rows.withColumn("__variables", responses.canonical(F.col("variables")))
    return responses.newest_of_files(keyed, ["model", "prompt_id", "__variables", "sample"]).drop("__variables")


def read_json_map(spark: SparkSession, path: str, key: str = "dump", value: str = "tokens") -> DataFrame:
    """One JSON object of numbers as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias(key, value))


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, count, total): a count file; the total is of tokens, or of occurrences where that is absent or 0."""
    schema = "total_word_occurrences bigint, total_corpus_tokens bigint, words array<struct<word: string, count: bigint>>"
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")
    total = F.coalesce(F.nullif("total_corpus_tokens", F.lit(0)), F.col("total_word_occurrences"))
    return r.select(F.explode("words").alias("w"), total.alias("total")).select("w.word", "w.count", "total")


def read_words(spark: SparkSession, path: str, comments: str = "prefix") -> DataFrame:
    """(word, line): trimmed, lower case, first seen of equal ones. Comments: lines that begin with, or hold, ``#``; or none."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "word"))
    w = raw.withColumn("word", F.lower(F.btrim("word"))).where("word <> ''")
    if comments == "prefix":
        w = w.where(~F.col("word").startswith("#"))
    elif comments == "anywhere":
        w = w.where(~F.col("word").contains("#"))
    return w.groupBy("word").agg(F.min("line").alias("line")).orderBy("line")


def read_path_index(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Lines of a (gzipped) list of paths, without blanks and comments, behind a prefix."""
    t = F.btrim("value")
    return spark.read.text(path).where((t != "") & ~t.startswith("#")).select(F.concat(F.lit(prefix), t).alias("path"))


def write_responses(rows: DataFrame, path: str, stamp: str) -> None:
    """JSON lines, a folder for each model and run: ``<path>/run=<stamp>/model_file=<model>``; what is there stays."""
    named = rows.withColumn("model_file", F.regexp_replace("model", "[^A-Za-z0-9._-]+", "_")).withColumn("run", F.lit(stamp))
    named.write.mode("append").partitionBy("run", "model_file").json(path)


def union_words(*lists: DataFrame) -> DataFrame:
    """(word, line): words of several lists once each, numbered in the order in which they are first seen."""
    out = None
    for i, words in enumerate(lists):
        part = words.select("word", F.struct(F.lit(i).alias("list"), F.col("line").cast("long").alias("line")).alias("seen"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("word").agg(F.min("seen").alias("seen"))
    return first.select("word", (F.row_number().over(Window.orderBy("seen", "word")) - 1).alias("line"))  # a vocabulary: a list of words


def missing_words(asked: DataFrame, present: DataFrame) -> DataFrame:
    """Words asked for that aren't there, in lower case."""
    return asked.select(F.lower("word").alias("word")).distinct().join(present.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def remaining(rows: DataFrame, done: DataFrame | None, *keys: str) -> DataFrame:
    """Rows whose keys aren't done yet."""
    return rows if done is None else rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def summary(rows: DataFrame, name: str, **counters: Column):
    """Rows with counters that are filled in as they pass, and the observation that holds them.

    ``rows`` are counted; each further counter is an aggregate, as of candidates or words.
    """
    from pyspark.sql import Observation

    o = Observation(name)
    return rows.observe(o, F.count("*").alias("rows"), *[c.alias(k) for k, c in counters.items()]), o


class Run:
    """Counters and seconds of a run: documents read, those that may hold a target, contexts found."""

    def __init__(self, docs: DataFrame, may_match: Column):
        import time

        self._began = time.time()
        held, self._documents = summary(docs, "documents", candidates=F.count(F.when(may_match, 1)))
        self.documents = held

    def watched(self, contexts: DataFrame) -> DataFrame:
        out, self._contexts = summary(contexts, "contexts", targets=F.approx_count_distinct("target"))
        return out

    def report(self) -> dict:
        """After an action on the watched contexts."""
        import time

        d, c = self._documents.get, self._contexts.get
        return {"documents": d["rows"], "candidates": d["candidates"], "contexts": c["rows"], "targets": c["targets"], "seconds": round(time.time() - self._began, 3)}
