"""Joins, searches and window matches against brute force, with edge rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from driftlex.llm import components as components_module
from driftlex.llm import decontaminate, licenses, ngram_join, rowflags, scratch, topk
from driftlex.llm.components import components
from driftlex.llm.npwords import NON_ALNUM, SPACE, Words, text_chunks
from driftlex.llm.rowflags import row_key, settle
from driftlex.llm.scratch import materialise

DOCS = "doc_id long, text string, lang string, extra int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    par, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
            par[find(j)] = find(i)
            links[i] += 1
            links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)], links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randrange(1, 160))]
        for _ in range(r.randrange(1, 12)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = word()
            rows.append((i, r.choice([" ", "  ", "\n"]).join(w) if r.random() < 0.8 else " ".join(w).upper()))
            i += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(i + k, passage + " " + " ".join(word() for _ in range(r.randrange(5, 90)))) for k in range(25)]
    i += 25
    rows += [(i, ""), (i + 1, "   "), (i + 2, None), (i + 3, "one two"), (i + 4, "ONE\ttwo"), (i + 5, "x" * 70_000), (i + 6, "x" * 70_000), (i + 6, "x" * 70_000)]
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, None, 1) for d, t in rows], DOCS).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similar_documents(df).collect())
    assert got == sorted(brute_components(rows))


def test_ngram_join_in_blocks(spark, monkeypatch):
    for name, value in (("LARGE", 2), ("CHUNK", 3), ("BLOCK", 4), ("PACK", 150)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "COMMON_SHARE", 1 / 8)
    rows = near_copies(5)
    df = spark.createDataFrame([(d, t, None, 1) for d, t in rows], DOCS).repartition(2)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similar_documents(df).collect())
    assert got == sorted(brute_components(rows))


def test_ngram_join_in_many_blocks_and_ranges(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("BLOCK_ROWS", 3), ("RANGE_SHINGLES", 40)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(9)
    df = spark.createDataFrame([(d, t, None, 1) for d, t in rows], DOCS).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similar_documents(df).collect())
    assert got == sorted(brute_components(rows))


def test_links_along_a_chain(spark, monkeypatch):
    # each text is near its neighbours only, so no prefix group holds much of the component
    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 64])) for i in range(100)] + [(100 + i, " ".join(words[60:124])) for i in range(3)]
    df = spark.createDataFrame([(d, t, None, 1) for d, t in rows], DOCS).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similar_documents(df).collect())
    assert got == sorted(brute_components(rows))
    assert len({c for _, _, c, _ in got}) == 1 and max(k for *_, k in got) < 10


def test_ngram_join_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    near = text("a").replace("a39", "zz")
    # two texts under one id are two documents; a null id is the least of none
    rows = [(7, text("a")), (7, text("b")), (None, near), (9, near), (None, text("c")), (3, text("b")), (7, text("a")), (None, None)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS).withColumn("key", F.lit(0)).withColumn("sig", F.lit("s"))
    got = sorted(((r.doc_id, r.component_id, r.n_copies) for r in ngram_join.similar_documents(df).collect()), key=str)
    assert got == sorted([(7, 7, 2), (7, 3, 2), (None, 7, 2), (9, 7, 2), (None, None, 1), (3, 3, 2), (7, 7, 2), (None, None, 1)], key=str)
    kept = settle(df.select("doc_id", "text").withColumn("k", row_key()), ngram_join.not_first(df), "k")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, text("a")), (3, text("b")), (None, text("c")), (None, None)], key=str)


@pytest.mark.parametrize("buckets", [2048, 1])
def test_settled_rows(spark, monkeypatch, buckets):
    monkeypatch.setattr(rowflags, "MOST_BUCKETS", buckets)
    monkeypatch.setattr(rowflags, "BUCKET_BITS", 32)
    rows = [(i, f"t{i % 50}") for i in range(400)] + [(None, "t"), (None, None), (1, "t1"), (1, "t1"), (2, "t2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", row_key())
    gone = df.where("doc_id % 3 = 0 or text is null").select(F.col("k").alias("key"), F.lit(False).alias("once"))
    once = df.where("doc_id in (1, 2)").select(F.col("k").alias("key"), F.lit(True).alias("once")).distinct()
    got = settle(df, materialise(gone.union(once), "flags"), "k").select("doc_id", "text").collect()
    want = [r for r in rows[:401] if r[0] is None or r[0] % 3]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_ngram_join_in_small_arrow_batches(spark):
    name, rows = "spark.sql.execution.arrow.maxBytesPerBatch", near_copies(9)
    before = spark.conf.get(name, None)
    spark.conf.set(name, "2000")  # a bound of the session's own stays
    try:
        df = spark.createDataFrame([(d, t, None, 1) for d, t in rows], DOCS).repartition(2)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similar_documents(df).collect())
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert got == sorted(brute_components(rows))


def test_arrow_batches_are_bounded(spark):
    scratch.bounded_batches(spark)
    rows = spark.range(40).select(F.repeat(F.lit("x"), 1 << 19).alias("text")).coalesce(1)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    found = [r.n for r in sizes.collect()]
    assert sum(found) >= 40 << 19 and max(found) <= scratch.BATCH_BYTES + (1 << 20)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_forest_keeps_components(spark, monkeypatch):
    monkeypatch.setattr(components_module, "LEAST_TASKS", 3)
    r = random.Random(14)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(90)] + [(500, 600 + i) for i in range(300)] * 3
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    few = components_module.forest(materialise(df, "edges"))
    assert few.count() < 0.75 * len(edges)
    pairs = lambda e: {(x.v, x.root) for x in components(e).collect()}
    assert pairs(few) == pairs(df)
    assert components_module.forest(materialise(df.where("false"), "edges")).collect() == []


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            par[y] = x
    got = {x.v: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in par if find(v) != v}


@pytest.mark.parametrize("separators, pattern", [(SPACE, r"[^\x20\x09-\x0D]+"), (NON_ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_words_of_chunks(separators, pattern):
    import pyarrow as pa

    texts = ["a b", None, "", "é ß-x\tЯ", " lead and trail ", "joined", "again"] * 3
    seen = []
    for a, b, data, off in text_chunks(pa.array(texts), 9):
        w = Words(data, off, separators)
        for i in range(b - a):
            seen.append([bytes(data[w.starts[k] : w.ends[k]]).decode() for k in range(w.first[i], w.first[i + 1])])
    assert seen == [re.findall(pattern, t or "") for t in texts]


def test_hash_folds_case_and_nothing_else():
    data = np.frombuffer("Word word wörd WÖRD".encode(), np.uint8)
    h = Words(data, np.array([0, len(data)]), SPACE).hashes()
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def brute_contamination(docs, bench, n=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = {}
    for i, t in bench:
        w = re.findall(pattern, lower(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = re.findall(pattern, lower(t))
        hit, items = set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in grams:
                    hit |= set(range(a, a + k))
                    items |= grams[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("sent", [10_000, 0])
def test_contamination(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "MOST_SENT", sent)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcé1") for _ in range(r.randrange(1, 4)))
    bench = [(i, " ".join(word() for _ in range(r.randrange(13, 40)))) for i in range(6)] + [(6, "Short item, HERE"), (7, ""), (8, None), (9, "one"), (6, "Short item, HERE")]
    docs = []
    for i in range(40):
        w = [word() for _ in range(r.randrange(0, 300))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = bench[r.randrange(6)][1].split()[: r.randrange(10, 20)]
        if i % 5 == 0:
            w += ["SHORT", "item!", "here"]
        docs.append((i, " ".join(w)))
    docs += [(40, None), (41, ""), (41, ""), (42, "one"), (43, bench[0][1] * 50)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    got = sorted(tuple(x) for x in decontaminate.contamination(df, spark.createDataFrame(bench, "item_id long, text string")).collect())
    assert got == sorted(brute_contamination(docs, bench))


def test_contamination_without_benchmark(spark):
    df = spark.createDataFrame([(1, "a b c", None, 0)], DOCS)
    got = decontaminate.contamination(df, spark.createDataFrame([], "item_id long, text string")).collect()
    assert [tuple(x)[:4] for x in got] == [(1, 3, 0, 0)] and not got[0].contaminated
    assert decontaminate.contamination(df.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def brute_top(rows, k=5, every=50):
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if a != b)
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 37)
    monkeypatch.setattr(topk, "QUERIES", 2)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(9)]) for i in range(260)]
    rows += [(i, list(rows[50][1])) for i in range(260, 300)]  # ties
    rows += [(300, None), (301, [float("nan")] * 9), (302, [None, 1.0]), (None, [1.0]), (303, []), (304, [1.0, 2.0]), (100, list(rows[3][1])), (350, [1e6, -3e5, 2.5])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == brute_top(rows)


def test_top_k_in_slices_looks_at_few(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 400)
    monkeypatch.setattr(topk, "SLICE_BYTES", 4096)
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 32)) * 0.2
    rows = [(i, (centres[i % 20] + r.normal(size=32) * 0.03).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, looked_at=True).collect()
    assert sorted(tuple(x)[:4] for x in got) == brute_top(rows)
    assert np.mean([x.looked_at for x in got]) < 0.25 * 400


def test_lists_and_cutoffs_lose_nothing():
    r = np.random.default_rng(6)
    for scale in (1, 1e5, 1e9, 1e13):
        q, v = np.floor(r.normal(size=(3, 10)) * scale), np.floor(r.normal(size=(300, 10)) * scale)
        lists, off = topk.block_lists(q, v)
        for j in range(3):
            exact = [sum(int(a) * int(b) for a, b in zip(q[j], x)) for x in v]
            assert [int(x) for x in topk.resolved(q[j], v)] == exact
            cutoff = float(sorted(exact)[-7])
            at = topk.collected(lists, off[j], j, np.zeros(300, bool), cutoff)
            assert {i for i, x in enumerate(exact) if x >= cutoff} <= set(at.tolist())


def test_top_k_of_few(spark):
    s = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], s)).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], s)).collect() == []
    assert [tuple(x) for x in topk.top_k(spark.createDataFrame([(0, [1.0]), (7, [0.5])], s)).collect()] == [(0, 1, 7, 256 * 128)]


def brute_licenses(text, known=None):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, found = re.findall(pattern, lower(text)), set()
    for name, template in known or licenses.TEMPLATES:
        t = re.findall(pattern, lower(template))
        want = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        step = max(1, len(t) // 4)
        for s in range(0, max(1, len(w)), step):
            part = w[s : s + len(t) + 2 * step]
            if want and 4 * len(want & {tuple(part[i : i + 5]) for i in range(len(part) - 4)}) >= 3 * len(want):
                found.add(name)
    return ",".join(sorted(found))


def test_licenses(spark):
    apache = licenses.TEMPLATES[1][1]
    gpl = licenses.TEMPLATES[4][1].split()
    mit = licenses.TEMPLATES[13][1].split()
    docs = [
        (0, "Text before. Released under the MIT License. And after"),
        (1, "x " * 30 + apache.upper() + " y" * 30 + " licensed under the apache license, version 2.0"),
        (2, " ".join(gpl[:20] + ["changed"] + gpl[21:])),
        (3, " ".join(gpl[:12])),
        (4, None),
        (5, ""),
        (6, "a b"),
        (0, "Released under the MIT License."),
        (7, "word " * 400 + " ".join(mit[:60] + ["inserted"] + mit[60:100] + mit[102:]) + " more" * 77),
        (8, "word " * 20_000 + " ".join(gpl[:-3])),
        (9, "Released very under the MIT License"),
    ]
    got = [(x.doc_id, x.licenses) for x in licenses.find_licenses(spark.createDataFrame([(d, t, "", 0) for d, t in docs], DOCS)).orderBy("doc_id", "spans").collect()]
    assert got == [(0, "mit"), (0, "mit"), (1, "apache-2.0"), (2, "gpl-3.0"), (3, ""), (4, ""), (5, ""), (6, ""), (7, "mit"), (8, "gpl-3.0"), (9, "")]
    spans = licenses.find_licenses(spark.createDataFrame([(0, docs[0][1], "", 0)], DOCS)).first().spans
    assert spans == "mit:0:9"
    assert licenses.find_licenses(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("sent", [200_000, 7])
def test_licenses_with_words_put_in_and_left_out(spark, monkeypatch, sent):
    monkeypatch.setattr(licenses, "MOST_SENT", sent)
    r = random.Random(12)
    docs, meant = [], 0
    for i in range(120):
        name, template = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = template.split()
        for _ in range(r.randrange(0, 1 + len(w) // 30)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [w[k], "other"], ["changed"]])
        before, after = (["".join(r.choice("abcdef") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(0, 90))] for _ in range(2))
        docs.append((i, " ".join(before + w + after)))
    got = {x.doc_id: x.licenses for x in licenses.find_licenses(spark.createDataFrame([(d, t, "", 0) for d, t in docs], DOCS)).collect()}
    want = {i: brute_licenses(t) for i, t in docs}
    assert sum(bool(x) for x in want.values()) > 90
    missed = [i for i in want if set(want[i].split(",")) - set(got[i].split(","))]
    assert len(missed) <= 0.01 * len(docs) and all(set(got[i].split(",")) <= set(want[i].split(",")) for i in want)


def test_licenses_stay_with_their_documents_on_any_input(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(i, f"text number {i} of the plain kind " * 3 + (mit if i % 50 == 0 else ""), i % 7, "x", None) for i in range(1500)] + [(50, "text number 50 of the plain kind " * 3 + mit, 1, "x", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, key string, words string")
    grouped = df.repartition(5).groupBy("doc_id", "row").agg(F.max("text").alias("text"))
    for given in (df.repartition(7), grouped):
        got = licenses.find_licenses(given).collect()
        assert len(got) == given.count()
        assert all((r.licenses == "mit") == (r.doc_id % 50 == 0) for r in got)


def test_many_windows_on_shuffled_inputs(spark, monkeypatch):
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(r.choices(words, k=40))) for i in range(8)]
    docs = [(i, " ".join(r.choices(words, k=60)) + (" " + bench[i % 8][1] if i % 10 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame([(i, t, i % 7, "x") for i, t in docs], "doc_id long, text string, row int, words string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    grouped = df.repartition(6).groupBy("doc_id").agg(F.max("text").alias("text"))
    monkeypatch.setattr(decontaminate, "MOST_SENT", 10)
    for given in (df.repartition(7), grouped):
        got = {x.doc_id: (x.n_words, x.contaminated) for x in decontaminate.contamination(given, items).collect()}
        assert got == {i: (len(t.split()), i % 10 == 0) for i, t in docs}
