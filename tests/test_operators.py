"""Scores, rates, samples, responses, statistics on small tables."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftlex.operators import annotation, langscore, mixtures, prompts, rates, responses, sampling, scoring, sensemodel, stats, trajectory
from driftlex.sources import files, jsonparts, warc


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_quality(spark):
    texts = ["The cat sat on the mat and it was happy to be there.", "too short", None, "a, b, c, d, e, f, g, h, i, j", "x | y | z | q | r | s | t | u", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.quality_score for r in scoring.with_quality(df).orderBy("i").collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.6, 0.1, 0.0])
    plan = scoring.with_quality(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the text is cut once


def test_english(spark, tmp_path):
    df = spark.createDataFrame([(0, "the cat is on the mat"), (1, "der Hund und die Katze"), (2, None), (3, "")], "i int, text string")
    known = spark.createDataFrame([("the cat sat on the mat", "en"), ("is the hat on the cat", "en"), ("der Hund und die Maus", "de"), ("die Katze und der Hut", "de"), (None, "en"), ("x", None)], "text string, lang string")
    trained = langscore.train(known, F.col("lang") == "en")
    assert math.isclose(trained.odds, 0.0)
    got = [r.lang_score for r in scoring.with_english(df, trained).orderBy("i").collect()]
    assert got[0] > 0.9 and got[1] < 0.1 and got[2:] == [0.0, 0.0]
    # the same by brute force
    count = {k: Counter() for k in (True, False)}
    for text, lang in [("the cat sat on the mat", "en"), ("is the hat on the cat", "en"), ("der Hund und die Maus", "de"), ("die Katze und der Hut", "de")]:
        t = re.sub("[^a-z]", " ", text.lower())
        count[lang == "en"].update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")
    every = set(count[True]) | set(count[False])
    share = lambda k, g: (count[k][g] + 0.5) / (sum(count[k].values()) + 0.5 * len(every))
    for i, text in enumerate(["the cat is on the mat", "der hund und die katze"]):
        own = [g for g in (text[i : i + 3] for i in range(len(text) - 2)) if g[1] != " " and g in every]
        x = sum(math.log(share(True, g) / share(False, g)) for g in own) / len(own) * min(40, len(own))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x)))
    trained.save(spark, str(tmp_path / "model"))
    again = langscore.EnglishModel.load(spark, str(tmp_path / "model"))
    assert (again.weights == trained.weights).all() and again.odds == trained.odds and again.score("é ü") == trained.score("é ü") == 0.0
    long = "the cat " * 300_000  # longer than a part
    assert again.score(long) > 0.9

    def model(batches):
        for b in batches:
            yield b.str.len() / 100.0

    got = [r.p for r in scoring.with_english(df, model, name="p").orderBy("i").collect()]
    assert got == pytest.approx([0.21, 0.22, 0.0, 0.0])


def test_cascade_scores_each_text_once(spark):
    df = spark.createDataFrame([(0, "the cat is on the mat and so it was for us"), (1, None), (2, "der Hund und die Katze")], "i int, text string")
    model = langscore.EnglishModel(np.zeros(langscore.GRAMS), np.ones(langscore.GRAMS, bool), 5.0)
    docs = scoring.with_quality(scoring.with_english(df, model, name="e"), name="q")
    kept = scoring.passes(scoring.cascade(docs, F.col("e"), F.col("q")))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("score(text") == 1 and plan.count("regexp_extract_all") == 1
    assert [(r.i, r.quality_score) for r in kept.select("i", "quality_score").collect()] == [(0, 1.0)]


def test_sense_scores_of_sure_and_rare_targets(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(batches):
        for b in batches:
            seen.add(len(b))
            yield pd.Series(np.full(len(b), 0.9))

    long = "a context that is surely long enough to be usable "
    rows = [("lit", long + str(i)) for i in range(5)] + [("dope", long), ("OMG ", long), ("omg", "x"), (None, long)]
    df = spark.createDataFrame(rows, "target string, target_context string")
    got = sorted(((r.target, r.rare, r.sense_score) for r in scoring.sense_scored(df, model, F.col("target_context"), least=3).collect()), key=str)
    assert got == sorted([("lit", False, 0.8)] * 5 + [("dope", True, None), ("OMG ", False, 1.0), ("omg", False, 1.0)], key=str)
    assert seen.value == 5


def test_scored_with_bypass(spark):
    def model(batches):
        for b in batches:
            yield pd.Series(np.full(len(b), 0.75))

    df = spark.createDataFrame([("OMG ", "c"), ("lit", "d"), (None, "e")], "target string, target_context string")
    got = scoring.scored(df, model, scoring.prompt("{target}: {context}", F.col("target"), F.col("target_context")), ["omg"])
    assert {r.target: r.sense_score for r in got.collect()} == {"OMG ": 1.0, "lit": 0.5, None: 0.5}
    assert one(spark, scoring.prompt("a {target} b {context}.", F.lit("{context}"), F.lit("x"))) == "a {context} b x."


def test_order_and_tolerance(spark):
    df = spark.createDataFrame([("b", None), ("a", 0.2), ("a", None), ("c", 0.9)], "group_key string, sense_score double")
    assert [tuple(r) for r in scoring.sense_order(df).collect()] == [("a", None), ("b", None), ("c", 0.9), ("a", 0.2)]
    t = spark.createDataFrame([("0.5",), ("0.1",), ("",), (None,), ("x",)], "nli_score string")
    assert scoring.tolerant(t, {"nli_score": 0.3, "absent": 1.0}).count() == 4


def test_peak_ties_and_smoothing(spark):
    r = spark.createDataFrame([(2014, "a", 1, 5.0), (2013, "a", 1, 5.0), (2015, "a", 0, 0.0)], "year int, target string, hits long, rate_per_million double")
    p = rates.peaks(r).first()
    assert (p.peak_year, p.total_hits) == (2013, 2)
    g = spark.createDataFrame([("a", i, i, 1_000_000) for i in range(5)], "target string, day int, hits long, tokens long")
    got = [x.smoothed_rate for x in rates.smoothed(g, "day", 3).orderBy("day").collect()]
    assert got == [0.5, 1.0, 2.0, 3.0, 3.5]


def test_poisson_interval():
    low, high = rates.poisson_interval(np.array([0, 1, 10, 1000]))
    assert low[0] == 0 and high == pytest.approx([3.6889, 5.5716, 18.3904, 1063.93], rel=1e-4)
    assert low[1:] == pytest.approx([0.025318, 4.7954, 938.97], rel=1e-4)


def test_filter_rates(spark):
    df = spark.createDataFrame([("a", 0.995), ("a", -0.5), ("b", 0.3), ("b", None)], "target string, sense_score double")
    got = {r.target: (r.occurrences, r["kept_at_0.99"], r["pct_filtered_at_0.99"]) for r in rates.filter_rates(rates.score_histogram(df), (0.99,)).collect()}
    assert got == {"a": (2, 1, 50.0), "b": (1, 0, 100.0), "ALL": (3, 1, pytest.approx(200 / 3))}


def test_trajectories(spark):
    y = [10.0, 40.0, 20.0, 100.0, 60.0]
    df = spark.createDataFrame([("a", 2013 + i, v) for i, v in enumerate(y)] + [("b", 2013, 1.0)], "target string, year int, pct_of_peak double")
    got = {r.target: r for r in trajectory.roughness(df).collect()}
    d = np.diff(y)
    assert got["a"].total_variation == pytest.approx(np.abs(d).sum() / 90) and got["a"].turns == 3
    assert got["a"].roughness == pytest.approx(np.sqrt((np.diff(d) ** 2).mean()) / np.std(y, ddof=1))
    assert got["b"].turns_z is None
    fit = [r.fit for r in trajectory.quadratic(df.where("target = 'a'")).orderBy("year").collect()]
    assert fit == pytest.approx(np.polyval(np.polyfit(range(5), y, 2), range(5)))
    low = {r.target: r.min_year for r in trajectory.lowest(df).collect()}
    assert low["a"] == 2013


def test_samples(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    s = sampling.sample_by(df, "g", 10, "id", seed=1)
    assert {r.g: r["count"] for r in s.groupBy("g").count().collect()} == {0: 10, 1: 10, 2: 10}
    assert sorted(r.id for r in s.collect()) == sorted(r.id for r in sampling.sample_by(df.repartition(7), "g", 10, "id", seed=1).collect())
    assert sampling.two_stage(df, "g", 20, 2, "id").count() == 20
    split = sampling.stratified_split(df, "g", 0.8, "id").groupBy("g", "is_train").count().collect()
    assert {(r.g, r.is_train): r["count"] for r in split}[(0, True)] == round(167 * 0.8)
    tokens = df.withColumn("t", F.array(F.concat(F.lit("a"), "id"), F.lit("b")))
    words = lambda n: sorted(tuple(r) for r in sampling.sample_tokens(tokens.repartition(n), "g", F.col("t"), 7, "id", seed=2).collect())
    order = lambda i, at: (hashlib.md5(f"{i}|{at}|2".encode()).hexdigest()[:16], i, at)
    want = [sorted((order(i, at), (g, i, at, f"a{i}" if at == 0 else "b")) for i in range(g, 500, 3) for at in (0, 1))[:7] for g in range(3)]
    assert words(2) == words(9) == sorted(x for w in want for _, x in w)
    few = tokens.where("id < 4").unionByName(spark.createDataFrame([(9, None, None), (10, None, ["c"] * 900), (11, 5, [])], "id long, g long, t array<string>"))
    got = Counter(r.g for r in sampling.sample_tokens(few, "g", F.col("t"), 7, "id").collect())
    assert got == {0: 4, 1: 2, 2: 2, None: 7}
    some = df.withColumn("g", F.when(F.col("id") < 5, None).otherwise(F.lit("x")))
    parts = {(r.g, r.is_train): r["count"] for r in sampling.stratified_split(some, "g", 0.6, "id").groupBy("g", "is_train").count().collect()}
    assert parts == {(None, True): 3, (None, False): 2, ("x", True): 297, ("x", False): 198}
    more = sampling.top_up(df, df.where("id < 6"), "g", 4, "id")
    assert more.count() == 6 and more.where("id < 6").count() == 0
    assert sampling.fixed(df.where("id < 100"), "g", 34, "id").select("g").distinct().count() == 1


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (0, 0, "y"), (0, 1, "x")], "t int, p int, s string")
    got = {r.slice: r for r in annotation.confusion(df, F.col("t"), F.col("p"), "s").collect()}
    assert (got["all"].tp, got["all"].precision, got["all"].accuracy) == (1, 0.5, 0.5)
    assert got["s=y"].recall == 0.0 and got["s=y"].tn == 1


def test_annotation_batch(spark):
    df = spark.createDataFrame([(i, "Lol!" if i % 2 else "lol", f"  some context number {i % 7} that is surely long enough ") for i in range(40)], "id long, target string, target_context string")
    b = annotation.annotation_batch(annotation.usable_contexts(df, spark.createDataFrame([("some context number 3 that is surely long enough",)], "text string")), 4, "id")
    assert b.count() == 4 and b.select("clean").distinct().count() == 4 and b.where("clean like '%3%'").count() == 0


@pytest.mark.parametrize(
    "text, want",
    [("B", ("B", "clean")), ("**B) rad**", ("B", "lenient")), ("A, B, C, D", (None, "enumeration")), ("A lot", ("A", "lenient")), ("", (None, "empty")), (None, (None, "empty")), ("D).", ("D", "lenient")), ("C)", ("C", "clean")), ("none", (None, "unparsed"))],
)
def test_answers(spark, text, want):
    assert tuple(one(spark, responses.answer(F.lit(text).cast("string")))) == want


def test_free_text_parsers(spark):
    year = lambda s: one(spark, responses.year_in(F.lit(s)))
    assert (year("2010s"), year("in 12010"), year("x1999, 2014"), year("none")) == (2010, None, 1999, None)
    yn = lambda s: one(spark, responses.yes_no(F.lit(s)))
    assert [yn(s) for s in ("not appropriate", "Anachronistic.", "“Yes”", "I say yes", "hmm", "ok then")] == [0, 0, 1, 1, None, 1]
    opts = one(spark, responses.options(F.lit("Pick. Multiple choice: A) lmao B) red pill C) haha D) glow-up")))
    assert opts == {"A": "lmao", "B": "red pill", "C": "haha", "D": "glow-up"}
    col = F.create_map(*[F.lit(x) for kv in opts.items() for x in kv])
    assert one(spark, responses.target_letter(F.lit("exp3_glow_up"), col)) == "D"
    got = one(spark, responses.json_rows(F.lit('ok {"rows":[{"text":"a","label":1}]} end'), "rows array<struct<text:string,label:int>>"))
    assert got.rows[0].text == "a"


def test_token_payloads(spark):
    toks = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(p).alias("logprob"), F.create_map(F.lit(t), F.lit(p)).alias("top")) for t, p in [("<|a|>", -0.1), ("final", -0.2), ("Red", -1.0), (" Pill", -0.5), (".", -0.1), ("<eos>", 0.0)]])
    rest = responses.without_routing(toks)
    n = responses.answer_length(rest)
    assert one(spark, responses.joined_tokens(rest, n)) == "Red Pill"
    assert one(spark, responses.joint_logprob(rest, n)) == pytest.approx(-1.5)
    assert one(spark, responses.strict_answer_length(rest)) == 1
    assert one(spark, responses.combined_probability(rest, F.lit("red pill"))) == pytest.approx(math.exp(-1.5))
    top = F.array(F.struct(F.lit("x").alias("token"), F.lit(0.0).alias("logprob"), F.create_map(F.lit(" Lit"), F.lit(-1.0), F.lit("lit"), F.lit(-2.0), F.lit("dope"), F.lit(-2.0), F.lit(" "), F.lit(0.0)).alias("top")))
    assert one(spark, responses.first_distribution(top)) == {"lit": pytest.approx(0.5), "dope": pytest.approx(0.5)}


def test_repeated_top_tokens_and_null_payloads(spark):
    top = "array<struct<token:string,logprob:double>>"
    content = F.array(F.struct(F.lit("x").alias("token"), F.lit(-1.0).alias("logprob"), F.expr("array(named_struct('token', 'x', 'logprob', -1D), named_struct('token', 'y', 'logprob', -2D), named_struct('token', 'x', 'logprob', -3D))").cast(top).alias("top_logprobs")), F.struct(F.lit("z").alias("token"), F.lit(0.0).alias("logprob"), F.lit(None).cast(top).alias("top_logprobs")))
    none = F.array().cast("array<string>")
    got = one(spark, responses.tokens_of(content, none, F.array().cast("array<double>"), F.array().cast("array<map<string,double>>")))
    assert [(t.token, t.top) for t in got] == [("x", {"y": -2.0, "x": -3.0}), ("z", {})]
    other = one(spark, responses.tokens_of(F.lit(None).cast("array<struct<token:string,logprob:double,top_logprobs:" + top + ">>"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit(None).cast("double")), F.lit(None).cast("array<map<string,double>>")))
    assert [(t.token, t.logprob, t.top) for t in other] == [("a", 0.0, {}), ("b", 0.0, {})]


def plain_span(tokens, response):
    want = (response or "").strip().replace(" ", "").lower()
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens) + 1):
            if response is not None and "".join(t.strip() for t, _ in tokens[i:j]).lower() == want:
                return math.exp(sum(p for _, p in tokens[i:j]))
    return math.exp(sum(p for _, p in tokens))


def test_combined_probability_equals_a_plain_search(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(150):
        toks = [(str(r.choice(["a", " b", "B ", "ab", " ", "", "c"])), float(-r.random())) for _ in range(r.integers(1, 9))]
        rows.append((i, toks, [None, "", "b", " A B", "abc", "zz", "ab"][i % 7]))
    df = spark.createDataFrame(rows, "i int, tokens array<struct<token:string,logprob:double>>, response string")
    got = {x.i: x.p for x in df.select("i", responses.combined_probability(F.col("tokens"), F.col("response")).alias("p")).collect()}
    for i, toks, want in rows:
        assert got[i] == pytest.approx(plain_span(toks, want)), (toks, want)


def test_text_responses_of_records(spark):
    records = spark.createDataFrame([("p", "m", None, 1), ("p", "n", "x", 2)], "prompt_id string, model string, variables string, k int")
    texts = spark.createDataFrame([("p", "m", None, " second ", 2), ("p", "m", None, " first", 1), ("p", "n", "y", "no", 1), ("p", "m", None, None, 0)], "prompt_id string, model string, variables string, response string, at int")
    got = {r.k: r.response for r in responses.with_text_response(records, texts, ["prompt_id", "model", "variables"], "at").collect()}
    assert got == {1: "first", 2: None}


def test_prompts_are_cut_once(spark):
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("X"))
    show = lambda t: one(spark, prompts.rendered(F.lit(t), values))
    assert show("{a} {b}") == "{b} X" and show("{{a}} {c} {} }{") == "{a} {c} {} }{" and show("") == "" and show("{{{b}}}") == "{X}"


def test_prompt_grid(spark):
    t = spark.createDataFrame([("p", "{a}-{b}", {"a": ["1", "2"], "b": ["x"]}, 2, None, None, None), ("off", "z", {"a": ["1"]}, 1, True, None, None), ("open", "{a}", {"a": ["1"]}, 0, None, None, "open")], "id string, user string, variables map<string,array<string>>, samples int, disabled boolean, enabled boolean, model_type string")
    models = spark.createDataFrame([("gpt-4",), ("org/m",)], "model string")
    got = prompts.requests(t, models)
    assert got.where("id = 'p'").count() == 8 and got.where("id = 'open'").count() == 1 and got.where("id = 'off'").count() == 0
    assert {r.prompt_text for r in got.where("id = 'p'").collect()} == {"1-x", "2-x"}
    assert prompts.requests(t, models, got).count() == 0
    assert prompts.pick_model(models, "GPT") == "gpt-4"
    with pytest.raises(ValueError):
        prompts.pick_model(models, "m0")


def test_statistics(spark):
    x, y = [1, 2, 2, 4, 7], [2, 1, 3, 5, 4]
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    p = stats.pearson(df, "x", "y").first()
    assert p.r == pytest.approx(np.corrcoef(x, y)[0, 1])
    s = stats.spearman(df, "x", "y").first()
    assert s.r == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])
    assert stats.p_value(0.5, 12) == pytest.approx(0.0979, abs=2e-4) and stats.p_value(1.0, 5) is None and stats.p_value(0.3, 2) is None
    r, m = 0.31, 25  # against the trapezoid rule on the density
    at = np.tan(np.linspace(math.atan(r * math.sqrt((m - 2) / (1 - r * r))), math.pi / 2 - 1e-9, 400_001))
    front = math.exp(math.lgamma((m - 1) / 2) - math.lgamma((m - 2) / 2)) / math.sqrt((m - 2) * math.pi)
    assert stats.p_value(r, m) == pytest.approx(2 * np.trapezoid(front * np.exp(-(m - 1) / 2 * np.log1p(at * at / (m - 2))), at), abs=1e-4)
    assert stats.pearson(df.withColumn("x", F.lit(1)), "x", "y").first().r is None


def test_ranks_without_and_with_groups(spark):
    r = np.random.default_rng(2)
    rows = [(int(r.integers(0, 9)), str(r.choice(["a", "b"])) if r.random() < 0.9 else None) for _ in range(200)]
    df = spark.createDataFrame(rows, "x int, g string")
    got = sorted((v.x, v.rank) for v in stats.ranked(df, "x", "rank").collect())
    want = pd.Series([x for x, _ in rows]).rank()
    assert got == sorted(zip([x for x, _ in rows], want))
    by = sorted(((v.g, v.x, v.rank) for v in stats.ranked(df, "x", "rank", "g").collect()), key=str)
    f = pd.DataFrame(rows, columns=["x", "g"])
    f["rank"] = f.fillna({"g": "?"}).groupby("g").x.rank()
    assert by == sorted([(None if pd.isna(g) else g, x, k) for x, g, k in f.itertuples(index=False)], key=str)


def test_vintages_and_fits(spark):
    peaks = spark.createDataFrame([("a", 2013), ("b", 2020)], "word string, peak_year int")
    said = spark.createDataFrame([("m", "a", 3), ("m", "b", 1), ("n", "b", 2), ("n", "c", 9)], "model string, word string, n long")
    corpus = spark.createDataFrame([("a", 1), ("b", 1)], "word string, n long")
    got = {r.model: (r.vintage, r.corpus_vintage, r.lag) for r in stats.vintage_lags(said, corpus, peaks, "model").collect()}
    assert got == {"m": (2014.75, 2016.5, -1.75), "n": (2020.0, 2016.5, 3.5)}


def mixture_rows(spark, p, said):
    words = [f"w{i:02d}" for i in range(p.shape[1])]
    shares = spark.createDataFrame([(2013 + y, w, float(p[y, j])) for y in range(len(p)) for j, w in enumerate(words)], "year int, word string, p double")
    counts = spark.createDataFrame([(m, w, int(n)) for m, row in said.items() for w, n in zip(words, row, strict=True) if n], "fit string, word string, n long")
    return mixtures.packed(shares, counts)


def test_mixtures_of_several_models(spark, monkeypatch):
    r = np.random.default_rng(3)
    p = r.dirichlet(np.ones(12), 4)
    said = {"a": r.integers(0, 50, 12), "b": (1000 * (0.7 * p[1] + 0.3 * p[3])).round(), "none": np.zeros(12)}
    years, cells = mixture_rows(spark, p, said)
    fitted = mixtures.weights(years, cells)
    got = {(x.fit, x.year): x.weight for x in fitted.collect()}
    assert {m for m, _ in got} == {"a", "b"} and years == [2013, 2014, 2015, 2016]
    for m in "ab":
        q = said[m] / said[m].sum()
        assert [got[m, y] for y in years] == pytest.approx(stats.em_weights(p, q), abs=1e-12)
    l2 = {(x.fit, x.year): x.weight for x in mixtures.weights(years, cells, "l2").collect()}
    assert l2["b", 2014] == pytest.approx(0.7, abs=0.02)
    kl = {x.fit: x.divergence for x in mixtures.divergence(mixtures.mixture_of(years, cells, fitted)).collect()}
    null = {x.fit: x.divergence for x in mixtures.divergence(mixtures.mixture_of(years, cells, mixtures.uniform(fitted))).collect()}
    assert kl["b"] == pytest.approx(stats.relative_entropy(said["b"] / said["b"].sum(), stats.em_weights(p, said["b"] / said["b"].sum()) @ p)) and all(kl[m] <= null[m] for m in "ab")
    assert {x.fit: x.vintage for x in mixtures.vintages(fitted).collect()}["b"] == pytest.approx(2014.6, abs=0.1)
    # the way of large fits, a few steps of it
    monkeypatch.setattr(mixtures, "MOST_WORDS", 3)
    monkeypatch.setattr(mixtures, "ROUNDS", 6)
    together = {(x.fit, x.year): x.weight for x in mixtures.weights(years, cells).collect()}
    for m in "ab":
        assert [together[m, y] for y in years] == pytest.approx(stats.em_weights(p, said[m] / said[m].sum(), rounds=6), abs=1e-12)


def test_mixture_intervals(spark):
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]])
    years, cells = mixture_rows(spark, p, {"m": [70, 40, 30]})
    one = sorted(map(tuple, mixtures.intervals(years, cells, 60).collect()), key=str)
    assert one == sorted(map(tuple, mixtures.intervals(years, cells.repartition(5), 60).collect()), key=str)
    w = stats.em_weights(p, np.array([70, 40, 30]) / 140)
    for fit, year, low, high, n in one:
        point = float(w @ years) if year is None else w[years.index(year)]
        assert fit == "m" and low <= point <= high and n == 60


def test_flags_of_words(spark):
    mixed = spark.createDataFrame([("m", "a", 0.1, 0.4), ("m", "b", 0.7, 0.2), ("m", "c", 0.1, 0.1), ("m", "d", 0.1, 0.0), ("m", "e", 0.0, 0.3)], "fit string, word string, p_model double, p_mix double")
    assert {r.word: (r.ratio and round(r.ratio, 2), r.flag) for r in mixtures.word_fit(mixed).collect()} == {"a": (0.25, -1), "b": (3.5, 1), "c": (1.0, 0), "d": (None, 1)}


def test_interval_and_counts_as_shares(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 1.0, 4.0), ("a", 2, 4.0, 3.0, 6.0), ("z", 1, 0.0, 0.0, 1.0)], "target string, day int, smoothed_rate double, rate_low double, rate_high double")
    got = {(r.target, r.day): (r.smoothed_rate, r.rate_low, r.rate_high) for r in rates.percent_of_peak_with_interval(df).collect()}
    assert got == {("a", 1): (50.0, 25.0, 100.0), ("a", 2): (100.0, 75.0, 150.0), ("z", 1): (0.0, 0.0, 1.0)}
    assert rates.nonzero(df).count() == 2
    r = spark.createDataFrame([("a", 2013, 2.0001)], "target string, year int, rate_per_million double")
    assert rates.reconstructed_counts(r, spark.createDataFrame([(2013, 3_000_000)], "year int, tokens long"), "year").first().k == 6


def test_year_accuracy(spark):
    df = spark.createDataFrame([("m", "w", "2013", True), ("m", "w", "2013", False), ("m", "w", None, True), ("m", "w", "", True)], "model string, word string, year string, correct boolean")
    assert [tuple(r) for r in responses.year_accuracy(df, "model").collect()] == [("m", "w", "2013", 1, 2, 0.5)]


def test_mixtures():
    r = np.random.default_rng(0)
    p = r.dirichlet(np.ones(30), 5)
    w = np.array([0.5, 0, 0.3, 0.2, 0])
    assert stats.em_weights(p, w @ p) == pytest.approx(w, abs=0.01)
    assert stats.l2_weights(p, w @ p) == pytest.approx(w, abs=1e-4)
    q = r.dirichlet(np.ones(30))
    kl = [stats.relative_entropy(q, stats.em_weights(p, q, n) @ p) for n in (1, 5, 50)]
    assert kl == sorted(kl, reverse=True)


def test_bootstrap(spark):
    n, years = np.array([50.0, 100.0, 20.0]), np.array([2013.0, 2015.0, 2020.0])
    r = stats.poisson_bootstrap(spark, n, lambda x: float(x @ years / x.sum()), 400).first()
    assert r.low < float(n @ years / n.sum()) < r.high and r.replicates == 400
    again = stats.poisson_bootstrap(spark, n, lambda x: float(x @ years / x.sum()), 400).first()
    assert (r.low, r.high) == (again.low, again.high)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{\n  "model": "m",\n  "sample": 1\n}\n\n{\n  "model": "n",\n  "sample": 2\n}\n{\n  "model": "cut')
    got = files.read_json_objects(spark, str(tmp_path / "a.jsonl"), "model string, sample int", "model")
    assert sorted((r.model, r.sample) for r in got.collect()) == [("m", 1), ("n", 2)]
    (tmp_path / "compact.jsonl").write_text('{"model": "a}{", "sample": 1}\n{"model": "b\\"}", "sample": 2}{"model": "c", "sample": 3}\n')
    got = files.read_json_objects(spark, str(tmp_path / "compact.jsonl"), "model string, sample int", strict=True)
    assert sorted((r["index"], r.model, r.sample) for r in got.collect()) == [(0, "a}{", 1), (1, 'b"}', 2), (2, "c", 3)]
    with pytest.raises(Exception, match="no JSON in a.jsonl"):
        files.read_json_objects(spark, str(tmp_path / "a.jsonl"), "model string", strict=True).collect()
    (tmp_path / "d.json").write_text(json.dumps({"CC-MAIN-2013-20": 5, "CC-MAIN-2014-10": 7}))
    assert {r.dump: r.tokens for r in files.read_json_map(spark, str(tmp_path / "d.json")).collect()}["CC-MAIN-2014-10"] == 7
    (tmp_path / "w.txt").write_text("# c\nLol\n\n rad # no\nlol\n")
    assert [r.word for r in files.read_words(spark, str(tmp_path / "w.txt")).collect()] == ["lol", "rad # no"]
    assert [r.word for r in files.read_words(spark, str(tmp_path / "w.txt"), "anywhere").collect()] == ["lol"]
    (tmp_path / "c.csv").write_text('﻿uri,"target_context"\nu,"a ""q"" \nb"\n')
    rows = files.read_csv(spark, str(tmp_path / "c.csv"))
    assert rows.columns == ["uri", "target_context"] and rows.first().target_context == 'a "q" \nb'
    files.write_by_dump(spark.createDataFrame([("d1", "x"), ("d2", "y")], "dump string, target string"), str(tmp_path / "out"))
    files.merge_shards(spark, str(tmp_path / "out"), str(tmp_path / "csv"))
    assert files.exists(spark, str(tmp_path / "csv/dump=d1")) and spark.read.parquet(str(tmp_path / "out")).where("dump = 'd1'").count() == 1
    with gzip.open(tmp_path / "paths.gz", "wt") as f:
        f.write("a/b.wet.gz\n# x\n\nc\n")
    assert [r.path for r in files.read_path_index(spark, str(tmp_path / "paths.gz"), "s3://b/").collect()] == ["s3://b/a/b.wet.gz", "s3://b/c"]
    (tmp_path / "n.json").write_text(json.dumps({"total_word_occurrences": 9, "total_corpus_tokens": 0, "words": [{"word": "a", "count": 2}]}))
    assert tuple(files.read_word_counts(spark, str(tmp_path / "n.json")).first()) == ("a", 2, 9)


def test_latest_responses_of_a_folder(spark, tmp_path):
    import os

    rec = lambda sample, text, v='{"a": "1", "b": "2"}': '{"model": "m", "prompt_id": "p", "variables": %s, "sample": %d,\n "response": "%s"}\n' % (v, sample, text)
    (tmp_path / "m_20240102_000000.jsonl").write_text(rec(0, "new", '{"b": "2", "a": "1"}') + rec(2, "twice") + rec(2, "last"))
    (tmp_path / "m_20240101_000000.jsonl").write_text(rec(0, "old") + rec(1, "only"))
    (tmp_path / "plain.jsonl").write_text(rec(3, "undated") + rec(1, "wins, as undated files come last"))
    os.utime(tmp_path / "plain.jsonl", (1, 1))
    schema = "model string, prompt_id string, variables map<string,string>, sample int, response string"
    got = {r.sample: r.response for r in files.read_responses(spark, str(tmp_path), schema).collect()}
    assert got == {0: "new", 1: "wins, as undated files come last", 2: "last", 3: "undated"}
    assert files.read_responses(spark, str(tmp_path), schema, latest_only=False).count() == 7


def test_sinks_words_and_counters(spark, tmp_path):
    rows = spark.createDataFrame([("org/m", 1), ("n", 2)], "model string, k int")
    for stamp in ("20240101_000000", "20240102_000000"):
        files.write_responses(rows, str(tmp_path / "out"), stamp)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 4 and {r[0] for r in back.select("model_file").distinct().collect()} == {"org_m", "n"}
    words = lambda *w: spark.createDataFrame([(x, i) for i, x in enumerate(w)], "word string, line int")
    assert [r.word for r in files.union_words(words("b", "a"), words("c", "a", "d")).orderBy("line").collect()] == ["b", "a", "c", "d"]
    assert sorted(r.word for r in files.missing_words(words("A", "x"), words("a")).collect()) == ["x"]
    from driftlex.operators.kwic import kwic, prefilter_pattern

    docs = spark.createDataFrame([("a lol b lol",), ("nothing",), (None,)], "text string")
    run = files.Run(docs, F.col("text").rlike(prefilter_pattern(["lol"])))
    run.watched(kwic(run.documents, ["lol"])).write.mode("overwrite").parquet(str(tmp_path / "ctx"))
    got = run.report()
    assert (got["contexts"], got["targets"]) == (2, 1) and got["candidates"] == 1 and got["seconds"] >= 0
    shards = spark.createDataFrame([("d1", i) for i in range(50)] + [("d2", 1)], "dump string, k int").repartition(4)
    files.write_by_dump(shards, str(tmp_path / "shards"))
    files.merge_shards(spark, str(tmp_path / "shards"), str(tmp_path / "merged"), delete=True)
    assert len(list((tmp_path / "merged/dump=d1").glob("*.csv"))) == 1 and not (tmp_path / "shards").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "merged")).count() == 51


def test_archives(spark, tmp_path):
    def rec(kind, head, body):
        h = f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n"
        return h.encode() + body + b"\r\n\r\n"

    wet = rec("warcinfo", "", b"x") + rec("conversion", "WARC-Target-URI: http://a\r\nWARC-Identified-Content-Language: eng,fra\r\nContent-Type: text/plain\r\n", "Héllo".encode()) + rec("conversion", "WARC-Identified-Content-Language: deu\r\n", b"nein") + rec("conversion", "", b"  ")
    (tmp_path / "a.wet.gz").write_bytes(gzip.compress(wet))
    (tmp_path / "b.warc").write_bytes(rec("response", "WARC-Target-URI: http://b\r\nContent-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=x\r\n\r\n<p>Hi</p>"))
    rows = warc.read_archives(spark, str(tmp_path))
    assert [(r.uri, r.payload) for r in warc.english_text(rows).collect()] == [("http://a", "Héllo")]
    page = rows.where("rec_type = 'response'").select(warc.page_text(F.col("content_type"), F.col("payload")).alias("t")).first()
    assert page.t == "Hi"


@pytest.mark.parametrize("zipped", [True, False])
def test_archives_in_any_ranges(spark, tmp_path, zipped):
    r = random.Random(8)
    want, raw, places = [], b"", []
    for i in range(60):
        body = bytes(r.randrange(256) for _ in range(r.randrange(0, 900)))
        if i % 9 == 0:  # what looks like the begin of a record, or of a gzip member
            body += b"\r\n\r\nWARC/1.0\r\nWARC-Type: no\r\nContent-Length: 4\r\n\r\nabcd" + b"\x1f\x8b\x08\x00" + gzip.compress(b"WARNING")
        one = f"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        places.append(len(raw))
        raw += gzip.compress(one) if zipped else one
        want.append((f"u{i}", body.decode("utf-8", "replace")))
    (tmp_path / "x.warc").write_bytes(raw)
    for split in (len(raw), len(raw) // 4 + 1, 997):
        df = warc.read_archives(spark, str(tmp_path / "x.warc"), split)
        assert df.rdd.getNumPartitions() == -(-len(raw) // split)
        assert sorted((x.uri, x.payload) for x in df.collect()) == sorted(want)


def test_pages_as_archives_and_back(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    warc.write_archives(pages.repartition(3), str(tmp_path / "w"), F.col("url"), F.col("html"))
    back = warc.read_archives(spark, str(tmp_path / "w" / "*.warc.gz"), 20_000)
    assert back.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, back.select("uri", "payload").collect())) == sorted((p.url, p.html) for p in pages.collect())


def test_stream_equals_batch(spark, data, tmp_path):
    from driftlex.operators.kwic import kwic
    from driftlex.plans.base import corpus
    from driftlex.streaming import ingest

    c = corpus(spark, data).select("doc_id", "text", "dump")
    c.repartition(3).write.parquet(str(tmp_path / "in"))
    docs = ingest.arrivals(spark, str(tmp_path / "in"), c.schema.simpleString()[7:-1].replace(":", " "), 1)
    q = ingest.stream_contexts(docs, ["the", "la"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = kwic(c, ["the", "la"], 20, ("doc_id", "dump"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == want.count()
    q = ingest.stream_counts(docs, ["the"], str(tmp_path / "counts"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    counts = sorted(map(tuple, want.where("target = 'the'").groupBy("dump", "target").count().collect()))
    now = lambda: sorted(map(tuple, ingest.current_counts(spark, str(tmp_path / "counts")).collect()))
    assert now() == counts
    versions = ingest._versions(spark, str(tmp_path / "counts"))
    assert len(versions) == 2
    # the last batch once more, as after a crash before its offset was committed
    before = {(r.dump, r.target): r.hits for r in spark.read.parquet(str(tmp_path / "counts" / f"version={versions[0]}")).collect()}
    again = spark.createDataFrame([(d, t, n - before.get((d, t), 0)) for d, t, n in counts if n > before.get((d, t), 0)], "dump string, target string, hits long")
    ingest.add_batch(again, versions[-1], str(tmp_path / "counts"))
    assert now() == counts and ingest._versions(spark, str(tmp_path / "counts")) == versions
    # and one that was killed half-way: its version is no version
    (tmp_path / "counts" / f"version={versions[-1] + 1}").mkdir()
    assert now() == counts


def test_a_loop_of_rounds_can_be_stopped(spark, tmp_path):
    from driftlex.streaming import ingest

    rows = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, g int")
    score = lambda r: r.withColumn("score", F.col("id") * 37 % 10)
    keep = lambda r: r.where("score >= 6")
    go = lambda rounds, name: ingest.collect_until(rows, None, score, keep, "g", 5, ("id",), rounds=rounds, ledger=str(tmp_path / name))
    whole = sorted(map(tuple, go(20, "whole").collect()))
    assert all(sum(r[1] == g for r in whole) == 5 for g in range(3))
    part = go(2, "stopped")
    size = len(part._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert part.count() < len(whole)
    rest = go(20, "stopped")
    assert sorted(map(tuple, rest.collect())) == whole
    assert len(rest._jdf.queryExecution().optimizedPlan().toString().splitlines()) == size
    # by brute force
    order = lambda i, seed: (hashlib.md5(f"{i}|{seed ^ 0x5A5A5A5A}".encode()).hexdigest()[:16], i)
    drawn = set()
    for n in range(20):
        for g in range(3):
            need = 5 - sum(i % 3 == g and i * 37 % 10 >= 6 for i in drawn)
            free = sorted((i for i in range(g, 90, 3) if i not in drawn), key=lambda i: order(i, n))
            drawn |= set(free[: max(0, need)])
    assert {r[0] for r in whole} == {i for i in drawn if i * 37 % 10 >= 6}


def test_inputs_are_read_once(spark, tmp_path):
    import os

    from driftlex.sources import ledger

    inside, out, book = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "book")
    inside.mkdir()
    for i in range(3):
        (inside / f"f{i}.txt").write_text(f"a{i}\nb{i}\n")
    seen = []

    def read(s, files):
        seen.append([os.path.basename(f) for f in files])
        return s.read.text(files).select("value")

    run = lambda **o: [os.path.basename(f) for f in ledger.advance(spark, str(inside), out, book, read, **o)]
    assert run(most_files=2) == ["f0.txt", "f1.txt"] and run() == ["f2.txt"] and run() == []
    assert seen == [["f0.txt", "f1.txt"], ["f2.txt"]]
    held = lambda: sorted(r.value for r in ledger.results(spark, out, book).collect())
    assert held() == ["a0", "a1", "a2", "b0", "b1", "b2"]
    (inside / "f3.txt").write_text("a3\n")

    def broken(s, files):
        return s.read.text(files).select(F.raise_error(F.lit("down")).cast("string").alias("value"))

    with pytest.raises(Exception, match="down"):
        ledger.advance(spark, str(inside), out, book, broken)
    assert held() == ["a0", "a1", "a2", "b0", "b1", "b2"] and run() == ["f3.txt"]
    assert "a3" in held()
    left = ledger.unfinished(spark, str(inside), book)
    assert left.isEmpty() and "content:binary" not in left._jdf.queryExecution().executedPlan().toString()


def test_response_bootstrap_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.array([(r.integers(1, 4), 0) if i < 100 else (0, r.integers(1, 4)) for i in range(200)], float)
    df = spark.createDataFrame([tuple(int(v) for v in row) for row in x], "the long, on long")
    got = stats.response_bootstrap(df, ["the", "on"], lambda v: float(v @ [2013, 2019] / v.sum()), 500).first()
    sums = np.array([x[r.integers(0, len(x), len(x))].sum(0) for _ in range(4000)])
    want = sums @ [2013, 2019] / sums.sum(1)
    assert got.replicates == 500 and got.mean == pytest.approx(want.mean(), abs=0.05)
    assert [got.low, got.high] == pytest.approx(np.percentile(want, [2.5, 97.5]).tolist(), abs=0.12)
    assert stats.response_bootstrap(spark.createDataFrame([], "a long, b long"), ["a", "b"], lambda v: 1.0, 10).first().replicates == 0


def test_first_token_dist_takes_all_turns(spark, tmp_path):
    from driftlex.plans import reply_queries

    # a routing word in the text makes the third word its first answer word
    rows = [(1, 1, "assistant", "rad it is"), (1, 3, "assistant", "lol"), (2, 5, "assistant", "<|a|> b glow up"), (2, 2, "user", "hm")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(x.model, x.token): x.records for x in reply_queries.first_token_dist(spark, str(tmp_path)).collect()}
    assert got == {("assistant", w + s): 1 for w in ("rad", "lol", "glow") for s in ("", "s")} | {("user", "hm" + s): 1 for s in ("", "s")}


def test_sense_model_equals_a_plain_fit(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(240):
        label = int(r.random() < 0.25)
        rows.append((i, " ".join(r.choices(words[:12] if label else words[6:], k=r.randint(0, 7))), label))
    rows += [(900, None, 1), (901, "w1", None), (902, "w2", 3)]
    df = spark.createDataFrame(rows, "i int, context string, label int").repartition(7)
    model = sensemodel.train(df, buckets=16)
    known = [x for x in rows if x[1] is not None and x[2] in (0, 1)]
    x = np.zeros((len(known), 17))
    x[:, -1] = 1
    for i, (_, text, _) in enumerate(known):
        for w in text.split():
            x[i, int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16] = 1
    y = np.array([k[2] for k in known], float)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    beta, keep = np.append(model.weights, model.bias), np.append(np.ones(16), 0)
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (w * (y - p)) - sensemodel.RIDGE * w.sum() * keep * beta).max() < 1e-6 * w.sum()
    got = {g.i: g.s for g in df.select("i", model.probability("context").alias("s")).collect()}
    assert [got[k[0]] for k in known] == pytest.approx(p.tolist()) and got[900] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    slopes = sensemodel.gradient(df, model).collect()
    assert {s.bucket: s.n for s in slopes} == {b: int(n) for b, n in enumerate(x[:, :16].sum(0)) if n} and max(abs(s.slope) for s in slopes) < 1e-8
    model.save(spark, str(tmp_path / "sense"))
    again = sensemodel.SenseModel.load(spark, str(tmp_path / "sense"))
    assert again.bias == model.bias and (again.weights == model.weights).all()
    empty = sensemodel.train(df.limit(0), buckets=4)
    assert empty.bias == 0 and not empty.weights.any()


def test_a_short_cutoff_is_made_good(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 2, ["w"] * 50) for i in range(40)], "id long, g long, t array<string>")
    want = sorted(map(tuple, sampling.sample_tokens(rows, "g", F.col("t"), 9, "id").collect()))
    monkeypatch.setattr(sampling, "MARGIN", -26.0)  # cutoffs that hold too few
    assert sorted(map(tuple, sampling.sample_tokens(rows, "g", F.col("t"), 9, "id").collect())) == want


def test_2001_columns(spark, monkeypatch):
    df = spark.range(2001).select(F.format_string("l%04d", "id").alias("lang"))
    assert len(rates.wide_columns(df, "lang")) == 2001
    monkeypatch.setattr(rates, "MOST_COLUMNS", 2000)
    with pytest.raises(ValueError, match="long"):
        rates.wide_columns(df, "lang")


def test_json_values_equal_a_decoder(spark):
    r = random.Random(6)
    value = lambda d: r.choice([1, 'a}{\\"[', None, [], {}, {"k": "]"}]) if d == 0 else r.choice([{"x": value(d - 1), "y\\": [value(d - 1)]}, [value(d - 1), value(0)]])
    texts = ["".join(json.dumps(value(r.randint(0, 3)), indent=r.choice([None, 1])) + r.choice([" ", "\n", "\n\n", "\t\ufeff"]) for _ in range(r.randrange(5))) for _ in range(80)]
    texts += ['{"a": 1}} {"b": 2}', '{"a": 1},{"b": 2}', '{"a": 1}\n{"cut": "x', "[1 2] {}", "{]}", "true 5 \"s\" nope 6", None, "  "]

    def plain(text):
        out, at, decoder = [], 0, json.JSONDecoder()
        while rest := text[at:].lstrip(" \t\r\n\ufeff"):
            at = len(text) - len(rest)
            try:
                _, end = decoder.raw_decode(text, at)
            except ValueError:
                break
            out.append(text[at:end])
            at = end
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for x in jsonparts.json_values(df, "t").orderBy("i", "index").collect():
        got.setdefault(x.i, []).append(x.json)
    assert got == {i: v for i, t in enumerate(texts) if t and (v := plain(t))}


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_json_files_in_any_ranges(spark, tmp_path, size):
    r = random.Random(size)
    want = []
    for f in ("one", "two"):
        objects = [{"id": i, "t": '}{ \\" [' * r.randrange(4), "deep": [{"x": [1, {}]}] * r.randrange(6)} for i in range(25)]
        text = "".join(json.dumps(o, indent=r.choice([None, 2])) + r.choice(["\n", " ", "\n\n"]) for o in objects)
        (tmp_path / f"{f}.jsonl").write_text(text + ('{"id": 99, "t": "cut' if f == "one" else '}\n{"id": 100}'))
        want += [(f"{f}.jsonl", i, o["id"], o["t"]) for i, o in enumerate(objects)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_json_objects(spark, str(tmp_path), "id long, t string, deep string")
        assert sorted((x.file, x["index"], x.id, x.t) for x in got.collect()) == sorted(want)
        assert all(json.loads(x.deep) is not None for x in got.collect())
        with pytest.raises(ValueError, match="no JSON in one.jsonl"):
            files.read_json_objects(spark, str(tmp_path), "id long", strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
