"""Contexts against a plain restatement of the rules."""

from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

from driftlex.functions import dumps as D
from driftlex.functions import text as T
from driftlex.operators.kwic import count_targets, kwic, kwic_tokens, read_targets, vocabulary_hits
from driftlex.operators.matcher import Matcher

PIECES = ["the", "The,", "of", "and", "red,", "pill", "(LOL!)", "...", "basic", "bitch", "lol’", "💀", "tl;dr", "É"]
SPACES = [" ", "\n", " ", " ", "  ", "\x0b", "\t"]
TARGETS = ["the", "basic bitch", "basic", "the and", "red pill", "lol", "of the", "💀", "é", "tl;dr", "of of of"]


def contexts(text, targets, k):
    spans, at = [], 0
    words = text.split()
    for w in words:
        at = text.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    keys = [w.strip(string.punctuation).lower() for w in words]
    out, i = [], 0
    while i < len(words):
        for t in targets:
            n = len(t.split(" "))
            if " ".join(keys[i : i + n]) == t and i + n <= len(words):
                lo, hi = max(0, i - k), min(len(words), i + n + k)
                out.append((i, t, text[spans[lo][0] : spans[hi - 1][1]]))
                i += n
                break
        else:
            i += 1
    return out


def test_contexts_equal_a_plain_scan(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) + r.choice(SPACES) for _ in range(r.randrange(0, 40))) for _ in range(300)]
    texts += ["", "take the red, pill now", "a lol b", "x\u000blol\u000by", "the the the", "of of of of", " lead the "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    got = sorted((x.doc_id, x.pos, x.target, x.target_context) for x in kwic(df, TARGETS, 2, ("doc_id",)).collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in contexts(t, TARGETS, 2))
    short = sorted((x.doc_id, x.pos, x.target) for x in kwic(df, TARGETS, 2, ("doc_id",), context=False).collect())
    assert short == [x[:3] for x in got]


def test_a_word_listed_first_hides_its_phrase(spark):
    df = spark.createDataFrame([("Basic, bitch",)], "text string")
    assert [x.target for x in kwic(df, ["basic", "basic bitch"]).collect()] == ["basic"]
    assert [x.target for x in kwic(df, ["basic bitch", "basic"]).collect()] == ["basic bitch"]
    assert [x.target for x in kwic_tokens(df, ["basic", "basic bitch"]).collect()] == ["basic bitch"]


def test_crawl_contexts(spark):
    df = spark.createDataFrame([("One 2 THREE don’t stop-now lol! yes",)], "text string")
    assert [tuple(x) for x in kwic_tokens(df, ["lol"], 2).collect()] == [(4, "lol", "don’t stop-now lol yes")]


def test_targets_and_filters(spark):
    assert read_targets(["# c", " The ", "", "Red Pill"]) == ["the", "red pill"]
    df = spark.createDataFrame([("x the. y",), ("nothing",)], "text string")
    assert kwic(df, ["the"], strict_prefilter=True).count() == 1


@pytest.mark.parametrize("text, word, n", [("u.s. u", "u", 2), ("Lol lolly LOL", "lol", 2), ("tl;dr x TL;DR", "tl;dr", 2), ("6-7 a", "6-7", 1), ("", "a", 0)])
def test_bounded_count(spark, text, word, n):
    assert spark.range(1).select(T.bounded_count(F.lit(text), word)).first()[0] == n


def test_vocabulary_hits(spark):
    df = spark.createDataFrame([(1, "the THE cat"), (2, None), (3, "")], "i int, text string")
    assert [tuple(x) for x in vocabulary_hits(df, ["the", "cat", "dog"], ("i",)).orderBy("word").collect()] == [(1, "cat", 1), (1, "the", 2)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.group_key(F.lit("Rock’n’Roll — it's!  Fun"))) == "rocknroll its fun"
    assert one(T.clean(F.lit(" a   b\n"))) == "a b"
    assert one(T.html_text(F.lit("<p>a<script>x<y</script>b &amp; <b>c</b><!-- d --></p>"))) == "a b & c"
    assert one(T.uri_root(F.lit("https://www.x.org/a"))) == "x" and one(T.uri_root(F.lit("http://x.org"))) == "http://x"
    assert one(T.target_of_file(F.lit("/a/b - lol annotations.csv"))) == "lol"
    assert one(T.file_slug(F.lit("org/model x"))) == "org_model_x"
    assert one(T.word_slug(F.lit("tl;dr"))) == "tldr" and one(T.word_slug(F.lit("💀"))) == "1f480"
    assert one(T.sampler_tokens(F.lit("An ox's hide, é"))) == ["ox's", "hide"]


def test_dumps(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert str(one(D.monday_of(F.lit("CC-MAIN-2013-20")))) == "2013-05-13"
    assert one(D.monday_of(F.lit("other"))) is None and one(D.in_dates(F.lit("other"), "2013-01-01", "2014-01-01"))
    assert one(D.in_range(F.lit("CC-MAIN-2015-06"), 2015, "CC-MAIN-2014", "CC-MAIN-2016")) and not one(D.in_range(F.lit("x"), 2015))


def test_a_long_target_list_in_rank_order(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["the", "of"]
    targets = []
    while len(targets) < 276:
        t = " ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 2, 3, 4])))
        if t not in targets:
            targets.append(t)
    r.shuffle(targets)
    texts = [" ".join(r.choice([*words, "x", "W3,", "(the)"]) for _ in range(r.randrange(0, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((x.doc_id, x.pos, x.target, x.target_context) for x in kwic(df, targets, 3, ("doc_id",)).collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in contexts(t, targets, 3))
    hidden = [t for t in targets if " " in t and t.split(" ")[0] in targets[: targets.index(t)]]
    assert hidden and not {x[2] for x in got} & set(hidden)


def test_matches_after_a_failed_prefix():
    m = Matcher(["a b c d", "b c", "c", "a a b"])
    assert m.matches("a b c x".split()) == [(1, 2, "b c")]
    assert m.matches("a b c d".split()) == [(0, 4, "a b c d")]
    assert m.matches("a a a b c".split()) == [(1, 3, "a a b"), (4, 1, "c")]
    assert Matcher(["c", "b c"]).matches("b c".split()) == [(0, 2, "b c")]
    assert Matcher([]).matches(["a"]) == [] and Matcher(["a"]).matches([]) == []


def test_counts_in_one_pass(spark):
    df = spark.createDataFrame([("d", "The the x"), ("d", None), ("e", ""), (None, "the, end")], "dump string, text string")
    assert {tuple(r) for r in count_targets(df, ["the", "end"], ("dump",)).collect()} == {("d", None, 3), ("d", "the", 2), ("e", None, 0), (None, None, 2), (None, "the", 1), (None, "end", 1)}
