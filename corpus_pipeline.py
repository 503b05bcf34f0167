"""The corpus pipeline: toxic texts, near copies and benchmark text go, personal data is masked, sources are mixed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
it kept; ``run`` writes each result to the shared folder and reads it back.
All but the last return the columns of ``documents``; the last adds
``n_copies`` and leaves out what the mixture doesn't take. Other columns of the
input are left out, and an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.llm import decontaminate as _decontaminate
from driftlex.llm import mixing, ngram_join, pii, toxicity
from driftlex.llm.rowflags import row_key, settle
from driftlex.llm.scratch import discard, materialise, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "__row_key"


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones, scores below a half.

    Rows are judged each by its own text, in all its windows however long it is; a null one counts as empty.
    """
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net, *COLUMNS).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts one row, that of the smallest id (null ids last); rows without words all stay.

    Rows go by identifier and text, so a repeated id doesn't carry another text's verdict.
    """
    flags = ngram_join.not_first(docs)
    return settle(docs.select(*COLUMNS).withColumn(KEY, row_key()), flags, KEY).select(*COLUMNS)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't made of benchmark windows to a twentieth or more.

    Each row is judged by its own text, however long; null and empty ones have no words and stay, repeated rows share a verdict.
    """
    keyed = docs.select(*COLUMNS).withColumn(KEY, row_key())
    found = _decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=(KEY,))
    flags = found.where("contaminated").select(F.col(KEY).alias("key"), F.lit(False).alias("once")).distinct()
    return settle(keyed, materialise(flags, "contaminated"), KEY).select(*COLUMNS)


def mask_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans of personal data replaced by their kind; null and empty ones stay as they are, repeated rows are masked each by itself."""
    return pii.redact(docs.select(*COLUMNS))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with their number of copies; those without words are not taken.

    Rows with equal identifier, text and source get the same number of copies.
    """
    sized = docs.select(*COLUMNS, row_key().alias("key"), mixing.size_of(F.col("text")).alias("size"))
    solved = mixing.solve(materialise(sized.select("source", "size", "key"), "sizes"))
    return mixing.with_copies(sized, solved).where("n_copies > 0").select(*COLUMNS, "n_copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: The network's scores can't be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's intermediate tables go once its result is written, and that with the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope() as keep:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
