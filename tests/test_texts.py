"""Page texts, dates, durations, answers in free text."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from driftlex.functions import text as T
from driftlex.operators import rates, responses


def column(spark, values, c):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(c(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a title="x > y">link</a> after', "link after"),
        ("<a title='a > \"b\"' href=x>l</a>", "l"),
        ('<img alt="never closed>t <b>u</b>', "t u"),
        ("a < b and c<d", "a < b and c"),
        ("1 < 2 <b>x</b>", "1 < 2 x"),
        ("<p>a<script>if (x < 1 && y > 2) '</p>'</SCRIPT >b", "a b"),
        ("a<script>var x = 1; <p>lost", "a"),
        ("a<style media='>'>p{}</style>b<noscript>no <b>way</b></noscript>c", "a b c"),
        ("<scripty>kept</scripty><styles>too</styles>", "kept too"),
        ("a<!-- <p>x</p> -- > still --><i>b</i><!-- open", "a b"),
        ("<!DOCTYPE html><?xml v?><![CDATA[ x ]]>y", "y"),
        ("caf&eacute; &amp;lt; &#233; &#xE9; &#8364; &copy;2 &middot; &AMP; &amp x &unknown; &am", "café &lt; é é € ©2 · & & x &unknown; &am"),
        ("a&nbsp;b&nbsp;&nbsp; c d", "a b c d"),
        ("cut <div cla", "cut"),
        ("x<br>y<br/>z</p", "x y z"),
        ("", ""),
        (None, None),
    ],
)
def test_page_text(spark, html, want):
    assert column(spark, [html], T.html_text) == [want]


def test_long_pages(spark):
    page = "<p class='" + "x" * 300_000 + "'>a</p><script>" + "var y = '<p>';\n" * 30_000 + "</script>" + "<b>w</b> &lt; " * 20_000
    assert column(spark, [page], T.html_text) == [" ".join(["a", *["w <"] * 20_000])]


def test_dates_of_three_forms(spark):
    got = column(spark, ["2013-05-07", "2013-5-7", "2013-05", "2013", "2013-13", "2013-02-30", "13-05", "May", "", None, "2013-05-07x"], T.parsed_date)
    d = datetime.date
    assert got == [d(2013, 5, 7), d(2013, 5, 7), d(2013, 5, 1), d(2013, 1, 1), None, None, None, None, None, None, None]


def test_durations(spark):
    df = spark.createDataFrame([(0.0,), (59.9,), (61.0,), (3599.0,), (3600.0,), (7384.0,), (360_000.0,)], "s double")
    assert [r[0] for r in df.orderBy("s").select(T.duration("s")).collect()] == ["0m 00s", "0m 59s", "1m 01s", "59m 59s", "1h 00m", "2h 03m", "100h 00m"]
    assert spark.range(1).select(T.from_epoch(F.lit(86_400)).cast("string")).first()[0] == "1970-01-02 00:00:00"


def test_examples_in_free_text(spark):
    reply = """Sure! {"has_non_slang_meaning": true, "examples": [{"text": " a ", "is_slang": 1}, {"text": "b", "is_slang": "0"}, {"text": "c", "is_slang": true},
      {"text": "d", "is_slang": 2}, {"text": "", "is_slang": 1}, {"text": null, "is_slang": 1}, {"text": "e"}, {"text": "f", "is_slang": "x"}, {"text": "g", "is_slang": 0.0}]} bye"""
    got = column(spark, [reply, "no object", '{"examples": "none"}', "{cut", None], responses.labelled_examples)
    assert [tuple(x) for x in got[0]] == [("a", 1), ("b", 0), ("c", 1), ("g", 0)]
    assert not any(got[1:])


def test_options_far_apart(spark):
    prompt = "Multiple choice: A) first " + "B) x " * 1500 + "A) last"
    got = column(spark, [prompt], responses.options)[0]
    assert got == {"A": "last", "B": "x"}


def test_words_in_capitals_beyond_ascii(spark):
    assert column(spark, ["ÉTÉ été Été étéx xété"], lambda c: T.bounded_count(c, "été")) == [3]
    assert column(spark, ["LOL lol"], lambda c: T.bounded_count(c, "lol")) == [2]


def test_totals_over_models(spark):
    counts = spark.createDataFrame([("m", "a", 2), ("n", "a", 3), ("m", "b", 5), ("m", "c", 9)], "model string, word string, n long")
    assert [tuple(r) for r in rates.ranked_totals(counts, 2).orderBy("rank").collect()] == [("c", 9, 1, 0), ("a", 5, 2, 0), ("b", 5, 3, 1)]
