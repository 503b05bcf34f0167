"""Timestamps, quality scores and the filter audit, against plain versions and on odd rows."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest

from driftlex.llm import filter_audit, quality, timestamps
from driftlex.llm.npwords import text_chunks

STAMPS = "stamp_id long, source string, zone string, raw string"
NY, BERLIN = "America/New_York", "Europe/Berlin"


def resolved(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], STAMPS)
    return [tuple(r) for r in timestamps.normalise(df, "stamp_id", **options).drop("stamp_id").orderBy("stamp_id").collect()] if rows else []


@pytest.mark.parametrize(
    ("raw", "zone", "want"),
    [
        ("1733025832", None, (1733025832_000000, "epoch", False, None)),
        ("1733942329007", None, (1733942329_007000, "epoch", False, None)),
        (" \t2024-09-06T16:32:23Z\r\n", "UTC", (1725640343_000000, "plain", False, None)),
        ("2024-02-09T02:07:34+05:30", NY, (1707424654_000000, "plain", False, None)),
        ("2024-02-09T02:07:34 -0530", None, (1707464254_000000, "plain", False, None)),
        ("20240502", "UTC", (1714608000_000000, "plain", False, None)),
        ("20240502 07:05", "Asia/Kolkata", (1714613700_000000, "plain", False, None)),
        ("26.01.2024 17:55:06", BERLIN, (1706288106_000000, "plain", False, None)),
        ("05 Nov 2024 02:48", NY, (1730792880_000000, "plain", False, None)),
        ("05 Nov 2024 12:48 AM", "UTC", (1730767680_000000, "plain", False, None)),
        ("05 Nov 2024 12:48PM", "UTC", (1730810880_000000, "plain", False, None)),
        ("2024-03-10 02:30:00", NY, (1710055800_000000, "plain", True, "gap")),
        ("2024-11-03 01:30:00", NY, (1730611800_000000, "plain", True, "repeat")),
        ("2024-11-03 01:30:00-0500", NY, (1730615400_000000, "plain", False, None)),
        ("2024-10-27 02:30", BERLIN, (1729989000_000000, "plain", True, "repeat")),
        ("2024-10-06 02:10", "Australia/Lord_Howe", (1728142800_000000, "plain", True, "gap")),
        ("05/05/2024", "UTC", (1714867200_000000, "plain", False, None)),
        ("25/10/2024 02:13", "UTC", (1729822380_000000, "plain", False, None)),
        ("10/25/2024 02:13", "UTC", (1729822380_000000, "plain", False, None)),
        ("03/04/2024", "UTC", (1709510400_000000, "default", True, None)),
    ],
)
def test_stamp_forms(raw, zone, want):
    assert timestamps.resolve(raw, zone, None) == want


@pytest.mark.parametrize(
    "raw",
    [None, "", " ", "n/a", "2024-01", "2024010", "2024-02-30", "31.04.2024", "2024-01-01 24:00", "2024-01-01 10:60", "2024-01-01T10:10:60", "2024-01-01 13:00 PM", "2024-01-01 00:10 AM", "2024-01-01 10:00+15:00", "2024-01-01 10:00+01:60", "2024-01-01  10:00", "05 nov 2024", "5 Nov 2024", "13/13/2024", "1999-01-01", "2024-01-01T10:10:10z", "٢٠٢٤-01-01", "2024-01-01\n10:00", "17330258321"],
)
def test_bad_stamps(raw):
    assert timestamps.resolve(raw, "UTC", None) == (None, "bad", False, None)


def test_zone_is_needed_without_an_offset():
    for zone in (None, "", "Nowhere/Land", "../etc", "Europe"):
        assert timestamps.resolve("2024-01-01", zone, None)[1] == "bad"
        assert timestamps.resolve("2024-01-01 10:00Z", zone, None)[1] == "plain"


ROWS = [
    ("a", "UTC", "25/10/2024"), ("a", "UTC", "26/10/2024"), ("a", "UTC", "10/25/2024"), ("a", "UTC", "03/04/2024"),
    ("b", "UTC", "10/25/2024"), ("b", "UTC", "03/04/2024"), ("b", "UTC", "25/10/2024 24:00"), ("b", "Nowhere", "25/10/2024"),
    ("c", "UTC", "10/25/2024"), ("c", "UTC", "25/10/2024"), ("c", "UTC", "03/04/2024"),
    (None, "UTC", "25/12/2024"), (None, "UTC", "03/04/2024"), ("", "UTC", "03/04/2024"),
]


def test_votes_by_source(spark, monkeypatch):
    rule = [r[1] for r in resolved(spark, ROWS)]
    assert rule == ["plain", "plain", "plain", "votes", "plain", "votes", "bad", "bad", "plain", "plain", "default", "plain", "votes", "default"]
    us = [r[0] for r in resolved(spark, ROWS)]
    april, march = 1712102400_000000, 1709510400_000000
    assert (us[3], us[5], us[10], us[12], us[13]) == (april, march, march, april, march)
    broadcast = resolved(spark, ROWS)
    monkeypatch.setattr(timestamps, "MOST_SOURCES", 0)
    assert resolved(spark, ROWS) == broadcast
    assert resolved(spark, ROWS, margin=2.0)[3][1] == "default"  # two votes to one are not over twice as many


def test_stamps_keep_rows_and_columns(spark, monkeypatch):
    df = spark.createDataFrame([(1, "s", "UTC", "03/04/2024", "x", 7)] * 3 + [(None, None, None, None, None, None)], STAMPS + ", __order string, one long")
    for most in (20_000, 0):
        monkeypatch.setattr(timestamps, "MOST_SOURCES", most)
        out = timestamps.normalise(df, "stamp_id", "one")
        assert out.columns == ["stamp_id", "one", "utc_us", "rule", "ambiguous", "wall"]
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, 7, 1709510400_000000, "default", True, None)] * 3 + [(None, None, None, "bad", False, None)]))
    assert timestamps.normalise(df.limit(0), "stamp_id").count() == 0


def test_many_sources_and_a_hot_one(spark):
    rows = [("hot", "UTC", f"{13 + i % 15:02d}/02/2024" if i % 3 else "03/04/2024") for i in range(600)] + [(f"s{i}", "UTC", r) for i in range(300) for r in ("02/13/2024" if i % 2 else "13/02/2024", "03/04/2024")]
    got = resolved(spark, rows)
    assert all(g[1] == "votes" for g, r in zip(got, rows, strict=True) if r[2] == "03/04/2024")
    days = {r[0]: g[0] for g, r in zip(got, rows, strict=True) if r[2] == "03/04/2024"}
    assert days["hot"] == days["s0"] == 1712102400_000000 and days["s1"] == 1709510400_000000


# quality


def chunk(texts):
    import pyarrow as pa

    return next(text_chunks(pa.array(texts)))[2:]


def test_ngrams_stay_in_their_text():
    texts = ["Ab ab ab!! 12", "", "ab", "céd | x y\nz", "Ab ab ab!! 12"]
    whole = quality.indicators(*chunk(texts))
    for i, t in enumerate(texts):
        alone = quality.indicators(*chunk([t]))[1]
        assert set(whole[1][whole[0] == i].tolist()) == set(alone.tolist())


def test_indicators_see_shapes_and_repeats():
    of = lambda t: set(quality.indicators(*chunk([t]))[1].tolist())
    assert of("ab ab ab cd") != of("ab cd ab ab") and of("Word") != of("WORD") and of("a&&& b") != of("a b") and of("") == set()
    assert of("ab cd") <= of("ab cd ef")


def test_hinge_fit_meets_the_optimality_conditions():
    r = np.random.default_rng(3)
    n, width = 60, 40
    x = (r.random((n, width)) < 0.2) * r.normal(size=(n, width))
    y = np.sign(x @ r.normal(size=width) + 0.3 * r.normal(size=n))
    cost = np.where(y > 0, 0.7, 1.3)
    cut = np.append(0, np.cumsum((x != 0).sum(1)))
    column, value = np.nonzero(x)[1], x[x != 0]
    w, bias, alpha = quality.hinge_fit(cut, column, value, y, cost, width)
    assert np.allclose(w, x.T @ (alpha * y), atol=1e-9) and np.isclose(bias, (alpha * y).sum())
    slack = y * (x @ w + bias) - 1
    assert (alpha >= 0).all() and (alpha <= cost).all()
    assert (slack[alpha <= 0] >= -2e-2).all() and (slack[alpha >= cost] <= 2e-2).all() and np.abs(slack[(alpha > 0) & (alpha < cost)]).max() < 2e-2
    primal = (w @ w + bias**2) / 2 + (cost * np.maximum(0, -slack)).sum()
    dual = alpha.sum() - (w @ w + bias**2) / 2
    assert primal - dual < 1e-2 * primal


def test_ratios_are_log_shares_of_counts():
    cut, column, y = np.array([0, 2, 3, 5]), np.array([0, 1, 1, 0, 2]), np.array([1, 0, 1])
    one, zero = np.array([3.0, 2, 2]), np.array([1.0, 2, 1])
    assert np.allclose(quality.ratios(cut, column, y, 3), np.log(one / one.sum() / (zero / zero.sum())))


def test_quality_learns_on_rows_that_it_has_not_seen(spark, data):
    from pyspark.sql import functions as F

    d = data.replace("sf0.001", "sf0.01")
    out = quality.op12_quality(spark, d)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    seen = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n, right, bad, caught = seen.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.sum(1 - F.col("quality")), F.sum((1 - F.col("quality")) * (1 - F.col("predicted")))).first()
    assert right >= 0.95 * n and caught >= 0.75 * bad
    assert out.where("score is null or score < 0 or score > 1 or isnan(score)").isEmpty() and out.count() == 1000


def good(i):
    return f"the old house number {i} stands by a quiet river and nobody has lived there for many years"


def bad(i):
    return f"BUY!! NOW&&& {i} || CLICK!! HERE&&& {i} || FREE!! STUFF&&&"


def test_quality_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double, __text string"
    rows = [(i, good(i) if i % 2 else bad(i), None, 3.0, "x") for i in range(300)]
    odd = [(None, good(1), None, None, None), (1000, None, None, None, None), (1001, "", None, None, None), (1, good(1), None, 3.0, "x"), (1002, bad(2) + " é" * 30_000, None, None, None)]
    docs = spark.createDataFrame(rows + odd, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (1001, 1), (5, None), (7, 3)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model, "doc_id", "lang").collect()
    assert len(out) == 305 and out[0].asDict().keys() == {"doc_id", "lang", "score"}
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert all((s > 0.7) == (i % 2 == 1) for i in range(300) for s in by[i])
    assert len(by[1]) == 1 and by[None] == by[1] and by[1000] == by[1001] and all(0 <= s <= 1 for v in by.values() for s in v)
    assert quality.score(docs.limit(0), model, "doc_id").count() == 0


def test_quality_of_long_texts_is_learned_from_windows(spark):
    docs = spark.createDataFrame([(i, " ".join((good if i % 2 else bad)(1000 * i + k) for k in range(400))) for i in range(40)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in quality.score(docs, model, "doc_id").collect())


@pytest.mark.parametrize(("label", "want"), [(1, 1.0), (0, 0.0), (None, 0.5)])
def test_quality_without_two_classes(spark, label, want):
    docs = spark.createDataFrame([(i, good(i)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in quality.score(docs, quality.train(docs, labels), "doc_id").collect()} == {want}


# the audit


def plain_audit(docs, labels):
    """The contract by brute force over documents."""
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, source, text in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            failed.add("C")
        if any(c in "#$%&*|" for c in text):
            failed.add("D")
        if i is not None and i > first[text]:
            failed.add("E")
        parts.setdefault(source or "", []).append((failed, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            gone = []
            for step, x in enumerate(order, 1):
                here = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(here)
                out[part, order, step] = [len(left), len(here), sum(x in r[0] for r in gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
                gone += here
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step].append(shapley[x])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, source string, text string, mask int, part string")
    lab = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, one int")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(d, lab).collect()}


def test_audit_equals_brute_force(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    pool = [None, "", "Ab", "same $ text", " ".join(words), " ".join(words[:100] * 3), " ".join(words) + " #", "A" * 30 + " " + " ".join(words), "\x0bé é é " * 90] + [" ".join(r.choices(words, k=r.randint(150, 260))) for _ in range(6)]
    docs = [(r.choice([None, *range(40)]) if r.random() < 0.2 else i, r.choice(["p", "q", None, ""]), r.choice(pool)) for i in range(200)] + [(3, "p", "same $ text")] * 4
    labels = [(r.randint(0, 210), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_nothing_and_without_labels(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    one = audited(spark, [(1, None, None)], [])
    assert len(one) == 600 and one == plain_audit([(1, None, None)], [])


def test_audit_counts_come_back_from_their_transform(spark):
    r = random.Random(9)
    judged = spark.createDataFrame([(r.choice("xy"), r.randrange(32), r.random() < 0.3, r.random() < 0.1) for _ in range(500)], "part string, mask int, good boolean, toxic boolean")
    rows = judged.collect()
    for c in filter_audit.cells(filter_audit.spectrum(judged)).collect():
        of = [x for x in rows if x["part"] == c["part"] and (c["label"] == "all" or x[c["label"]])]
        assert c["counts"] == [sum(x["mask"] == m for x in of) for m in range(32)]
