"""Keyword in context: extraction of target words and phrases, row by row.

Texts go to tasks in Arrow batches, and each is walked once by a trie over its
tokens (``matcher``). Nothing is shuffled, and only the columns asked for and the
text leave the scan. Where matches are counted only, their tokens are never cut
out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlex.functions import text as T
from driftlex.operators.matcher import LETTERS, TOKEN, Matcher, lowered
from driftlex.sources.shared import bounded_batches

#: Rows and characters of contexts after which a batch is handed on.
BATCH_ROWS, BATCH_CHARS = 20_000, 8 << 20


def read_targets(lines: list[str], comment: str = "#") -> list[str]:
    """Targets of a word list: trimmed, lower case, in order, without blanks and comment lines."""
    return [x for x in (line.strip().lower() for line in lines) if x and not x.startswith(comment)]


def prefilter_pattern(targets: list[str]) -> str:
    """Pattern of documents worth reading: a target between white space, with punctuation around it."""
    quoted = [r"\s+".join(f"\\Q{w}\\E" for w in t.split(" ")) for t in targets]
    return rf"(?i)(?:^|\s)\p{{Punct}}*(?:{'|'.join(quoted)})\p{{Punct}}*(?:\s|$)"


def _each_text(rows: DataFrame, keep: tuple[str, ...], text: str, found: Callable[[str], list[tuple]], fields: list[pa.Field], schema: str) -> DataFrame:
    """``keep`` columns and what ``found`` gives for each text, a row for each of its tuples; null texts are left out."""
    bounded_batches(rows.sparkSession)
    own = rows.where(F.col(text).isNotNull()).select(*keep, F.col(text).cast("string").alias("__text"))
    names = [*keep, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            out: list[tuple] = []
            size = 0

            def put(batch=batch):
                kept = batch.take(pa.array(owner, pa.int64()))
                columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
                return pa.RecordBatch.from_arrays([*kept.columns[:-1], *[pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]], names=names)

            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                got = found(value.as_py())
                owner += [i] * len(got)
                out += got
                size += sum(len(x) for r in got for x in r if isinstance(x, str))
                if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield put()
                    owner, out, size = [], [], 0
            if out:
                yield put()

    kept = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in keep)
    return own.mapInArrow(run, kept + schema)


_POS, _TARGET, _CONTEXT = pa.field("pos", pa.int32()), pa.field("target", pa.string()), pa.field("target_context", pa.string())


def kwic(docs: DataFrame, targets: list[str], k: int = 20, keep: tuple[str, ...] = (), text: str = "text", context: bool = True, strict_prefilter: bool = False) -> DataFrame:
    """A row for each match: the ``keep`` columns, ``pos`` (token), ``target``, and ``target_context`` of k tokens on each side.

    At each token the first target in list order that equals its key, or the blank-joined keys from it,
    matches; matches don't overlap, across all targets. The context is the original text.
    ``strict_prefilter`` first drops documents that the plain pattern misses.
    """
    if strict_prefilter:
        docs = docs.where(F.col(text).rlike(prefilter_pattern(targets)))
    matcher = Matcher(targets)

    def places(value: str) -> list[tuple]:
        return [(at, target) for at, _, target in matcher.matches(value.split())]

    def contexts(value: str) -> list[tuple]:
        tokens = value.split()
        kept = matcher.matches(tokens)
        if not kept:
            return []
        spans = [m.span() for m in TOKEN.finditer(value)]
        return [(at, target, value[spans[max(0, at - k)][0] : spans[min(len(tokens), at + n + k) - 1][1]]) for at, n, target in kept]

    if not context:
        return _each_text(docs, keep, text, places, [_POS, _TARGET], "pos int, target string")
    return _each_text(docs, keep, text, contexts, [_POS, _TARGET, _CONTEXT], "pos int, target string, target_context string")


def count_targets(docs: DataFrame, targets: list[str], by: tuple[str, ...], text: str = "text") -> DataFrame:
    """(by, target, n) in one pass over the texts: matches of each target, and under a null target all tokens.

    The result has a row for each group and target, and is cached: what is derived from it (lists of
    periods and words, rates, grids) doesn't read the texts again.
    """
    matcher = Matcher(targets)

    def counts(value: str) -> list[tuple]:
        tokens = value.split()
        return [(None, len(tokens)), *Counter(target for _, _, target in matcher.matches(tokens)).items()]

    each = _each_text(docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))), by, text, counts, [_TARGET, pa.field("n", pa.int64())], "target string, n long")
    return each.groupBy(*by, "target").agg(F.sum("n").alias("n")).cache()


def kwic_tokens(docs: DataFrame, targets: list[str], k: int = 10, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The crawl variant: letter tokens, phrases before single words, the context lower-case tokens joined by blanks."""
    matcher = Matcher(targets, phrases_first=True, key=lowered)

    def contexts(value: str) -> list[tuple]:
        tokens = LETTERS.findall(value)
        return [(at, target, " ".join(tokens[max(0, at - k) : at + n + k]).lower()) for at, n, target in matcher.matches(tokens)]

    return _each_text(docs, keep, text, contexts, [_POS, _TARGET, _CONTEXT], "pos int, target string, target_context string")


def vocabulary_hits(rows: DataFrame, vocabulary: list[str], keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keep, word, n): bounded occurrences of each vocabulary item in each row, each item counted by itself."""
    found = F.array(*[F.struct(F.lit(w).alias("word"), T.bounded_count(text, w).cast("long").alias("n")) for w in vocabulary])
    return rows.where(F.col(text) != "").select(*keep, F.explode_outer(F.filter(found, lambda f: f["n"] > 0)).alias("f")).where("f is not null").select(*keep, "f.word", "f.n")
