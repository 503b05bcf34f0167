"""Scores and filters of context rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from driftlex.functions import text as T
from driftlex.operators import langscore
from driftlex.sources.shared import bounded_batches, worked_out

# English function words that a running text holds, and signs stripped from its words.
FUNCTION_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us",
    "in", "on", "at", "to", "of", "and", "or", "but", "if", "not", "so",
    "for", "with", "as", "by", "from", "do", "does", "did", "will",
    "would", "could", "should", "have", "has", "had", "that", "this",
    "than", "then", "when", "what", "which", "who", "how", "there",
)
STRIPPED = ".,!?;:\"'()[]{}-"
# Targets that are slang in any sense, and so bypass a sense model.
ALWAYS_SLANG = (
    "omg", "omgggg", "lmfao", "lmaooo", "lmaoooo", "lmaooooo",
    "legit", "situationship", "💀", "circlejerked", "meme'd", "meme’d", "memed",
    "cappin", "snoozefest", "speedrun", "speedran", "speedrunning", "cluttercore",
    "tl;dr", "kekw", "omegalul", "lul", "peepoparty", "pogchamp", "ragequit", "stunlocked",
    "gatekeeping", "😭", "brooo", "broooo", "brooooo", "brooooooo", "yooo", "yoooo", "yooooo",
    "yoooooo", "nahhh", "nahhhh", "nahhhhh", "omggg",
)
LANG_LEAST, QUALITY_LEAST = 0.85, 0.70
# Fewest tokens of prose; (share, penalty) below which function words are too few; above which commas and
# separators are too many.
LEAST_TOKENS = 8
FEW_FUNCTION_WORDS = ((0.04, 0.5), (0.08, 0.2))
MANY_COMMAS = ((0.12, 0.4), (0.06, 0.15))
MANY_SEPARATORS = ((0.04, 0.4),)
# What trends leave out, and the sense score from which a row counts.
EXCLUDED_TERMS, EXCLUDED_YEARS, SENSE_LEAST = ("💀", "😭"), (2013,), 0.99


def _penalty(share: Column, steps: tuple, above: bool) -> Column:
    out = None
    for limit, loss in steps:
        met = share > limit if above else share < limit
        out = F.when(met, loss) if out is None else out.when(met, loss)
    return out.otherwise(0.0)


def _counted(rows: DataFrame, text: str, words: tuple[str, ...]) -> DataFrame:
    """``__n`` tokens and ``__f`` function words; the text is cut once, in a projection of its own."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(f"[^{T.WS}]+"), F.lit(0))
    known = F.filter("__tokens", lambda x: F.lower(F.btrim(x, F.lit(STRIPPED))).isin(list(words)))
    return rows.withColumn("__tokens", tokens).withColumn("__n", F.size("__tokens")).withColumn("__f", F.size(known)).drop("__tokens")


def with_quality(rows: DataFrame, text: str = "text", name: str = "quality_score", words: tuple[str, ...] = FUNCTION_WORDS) -> DataFrame:
    """``name``: heuristic share of running prose, 0 to 1; 0 for fewer than eight tokens or a null."""
    c, n = F.col(text), F.col("__n")
    count = lambda sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    df = _counted(rows, text, words).withColumn("__c", count(",")).withColumn("__s", count("|") + count(" / ") / 3)
    score = F.lit(1.0) - _penalty(F.col("__f") / n, FEW_FUNCTION_WORDS, False) - _penalty(F.col("__c") / n, MANY_COMMAS, True) - _penalty(F.col("__s") / n, MANY_SEPARATORS, True)
    score = F.when(c.isNull() | (n < LEAST_TOKENS), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return worked_out(df, "__n", "__f", "__c", "__s").withColumn(name, score).drop("__n", "__f", "__c", "__s")


def with_english(rows: DataFrame, model: langscore.EnglishModel | Callable[[Iterator[pd.Series]], Iterator[pd.Series]], text: str = "text", name: str = "lang_score") -> DataFrame:
    """``name``: how likely a text is English, 0 to 1, and 0 for a null or a text without letters.

    ``model`` is a trained one, or maps batches of texts to probabilities.
    """
    if isinstance(model, langscore.EnglishModel):
        return langscore.with_score(rows, model, text, name)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return worked_out(rows.withColumn(name, F.coalesce(F.pandas_udf(run, t.DoubleType())(F.coalesce(F.col(text), F.lit(""))), F.lit(0.0))), name)


def cascade(rows: DataFrame, lang: Column, quality_: Column, least: float = LANG_LEAST) -> DataFrame:
    """``lang_score``, and ``quality_score`` where the language passes, 1 elsewhere; a missing language score is 1."""
    lang = F.coalesce(lang, F.lit(1.0))
    return rows.withColumn("lang_score", lang).withColumn("quality_score", F.when(F.col("lang_score") >= least, quality_).otherwise(1.0))


def passes(rows: DataFrame, lang_least: float = LANG_LEAST, quality_least: float = QUALITY_LEAST, score_all: bool = False) -> DataFrame:
    return rows if score_all else rows.where((F.col("lang_score") >= lang_least) & (F.col("quality_score") >= quality_least))


def tolerant(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows whose scores reach each limit; a score that is absent, empty or no number passes."""
    for name, least in limits.items():
        if name in rows.columns:
            rows = rows.where(F.coalesce(F.expr(f"try_cast(`{name}` as double) >= {float(least)}D"), F.lit(True)))
    return rows


def scored(rows: DataFrame, score: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], prompt: Column, bypass: list[str], target: str = "target", name: str = "sense_score") -> DataFrame:
    """Sense scores from a pluggable model; targets in ``bypass`` get 1 without it.

    ``score`` maps batches of prompts to probabilities p; the score is 2p - 1. The rows are read once:
    those that the model isn't asked about are left out of its batches.
    """
    sure = F.coalesce(F.lower(F.btrim(F.col(target))).isin(bypass), F.lit(False))
    return _asked(rows, score, prompt, ~sure, F.when(sure, 1.0), name)


def _asked(rows: DataFrame, score: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], prompt: Column, wanted: Column, other: Column, name: str) -> DataFrame:
    """``name``: the model's score where ``wanted``, else ``other``. The model sees the wanted prompts only, in order."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        masks: deque[np.ndarray] = deque()

        def prompts() -> Iterator[pd.Series]:
            for text, ask in batches:
                masks.append(ask.to_numpy(bool))
                if masks[-1].any():
                    yield text[masks[-1]].reset_index(drop=True)

        held = np.empty(0)
        for got in score(prompts()):
            held = np.append(held, np.asarray(got, float))
            while masks and len(held) >= masks[0].sum():
                mask = masks.popleft()
                out, n = np.full(len(mask), np.nan), mask.sum()
                out[mask], held = held[:n], held[n:]
                yield pd.Series(out)
        for mask in masks:  # batches without a wanted prompt
            if mask.any():
                raise ValueError("the model gave fewer scores than it got prompts")
            yield pd.Series(np.full(len(mask), np.nan))
        if len(held):
            raise ValueError("the model gave more scores than it got prompts")

    bounded_batches(rows.sparkSession)
    model = F.pandas_udf(run, t.DoubleType())
    asked = rows.withColumn("__ask", wanted).withColumn("__p", model(F.when(F.col("__ask"), prompt), F.col("__ask")))
    return worked_out(asked, "__p").withColumn(name, F.when(F.col("__ask"), F.round(2 * F.col("__p") - 1, 4)).otherwise(other)).drop("__ask", "__p")


def sense_scored(rows: DataFrame, score: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], prompt: Column, always: tuple[str, ...] = ALWAYS_SLANG, least: int = 50, name: str = "sense_score") -> DataFrame:
    """``name``, ``group_key`` and ``rare``: 1 for targets that are slang in any sense, null for those of rare groups, else the model's.

    Neither kind of row reaches the model.
    """
    routed = rare_groups(rows, least, always=always)
    sure = F.coalesce(F.lower(F.btrim(F.col("target"))).isin(list(always)), F.lit(False))
    return _asked(routed, score, prompt, ~sure & ~F.col("rare"), F.when(sure & ~F.col("rare"), 1.0), name)


def prompt(template: str, target: Column, context: Column) -> Column:
    """``{target}`` and ``{context}`` of a template filled in; values aren't read again."""
    out, rest = [], template
    while rest:
        at = [(rest.find(k), k) for k in ("{target}", "{context}") if k in rest]
        if not at:
            out.append(F.lit(rest))
            break
        i, k = min(at)
        out += [F.lit(rest[:i]), target if k == "{target}" else context]
        rest = rest[i + len(k) :]
    return F.concat(*out)


def rare_groups(rows: DataFrame, least: int = 50, low: int = 40, high: int = 600, always: tuple[str, ...] = ()) -> DataFrame:
    """``rare``: whether a target's group has fewer than ``least`` usable contexts; such rows skip the model.

    Targets in ``always`` bypass the model anyway: they count for no group and are never rare.
    """
    rows = rows.withColumn("group_key", T.group_key("target"))
    sure = F.coalesce(F.lower(F.btrim("target")).isin(list(always) or [""]), F.lit(False))
    usable = F.coalesce(F.length(T.clean("target_context")).between(low, high), F.lit(False)) & ~sure
    counts = rows.groupBy("group_key").agg(F.sum(usable.cast("long")).alias("usable"))
    return rows.join(F.broadcast(counts), "group_key").withColumn("rare", (F.col("usable") < least) & ~sure)


def sense_filter(rows: DataFrame, least: float, score: str = "sense_score", score_all: bool = False) -> DataFrame:
    """Rows without a score or of ``least`` or more."""
    return rows if score_all else rows.where(F.col(score).isNull() | (F.col(score) >= least))


def sense_order(rows: DataFrame, *ties: str, score: str = "sense_score") -> DataFrame:
    """Unscored rows first, by group, then by falling score."""
    return rows.orderBy(F.col(score).isNotNull(), F.when(F.col(score).isNull(), F.col("group_key")), F.desc(score), *ties)


def counted(rows: DataFrame, least: float = SENSE_LEAST, drop_terms: tuple[str, ...] = EXCLUDED_TERMS, drop_years: tuple[int, ...] = EXCLUDED_YEARS, score: str = "sense_score") -> DataFrame:
    """Rows that count towards trends: scored ``least`` or more, outside excluded terms and years."""
    out = rows.where(F.col(score) >= least)
    if drop_terms:
        out = out.where(~F.btrim("target").isin(list(drop_terms)))
    return out.where(~F.col("year").isin(list(drop_years))) if drop_years else out
