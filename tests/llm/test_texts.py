"""Spans, classifiers, mixing, chat formatting and the pipeline on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlex.llm import chat, language, mixing, pii, secrets, toxicity

DOCS = "doc_id long, text string, base string, score double"
TEXTS = [
    "mail a.b@c-d.example.com, or x@y; also me@a.b@c.d_e@f.gh and é jo@x.org!",
    "ips 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1..2.3.4 9.9.9",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 5500000000000004 x4111111111111111y 0000 0000 0000 00",
    "call +1 (212) 555-0199 or +49 30 1234567. no +12 ++1 23 456 789 012 +1(((((",
    "9" * 30_000 + " " + "a" * 30_000 + "@" + "b.c" * 10_000,
    "a." * 20_000 + "@" + "x." * 20_000 + "y",
    "",
    None,
    "   ",
]
KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    x = [int(c) for c in d[::-1]]
    return sum(x[::2] + [2 * c - 9 * (c > 4) for c in x[1::2]]) % 10 == 0


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)] if len(t) < 20_000 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))] if len(t) < 20_000 else []
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_base_spans(spark):
    r = random.Random(1)
    pieces = ["a@b.co", "1.2.3.4", "4111111111111111", "+12125550199", "x", "-", ".", " ", "@", "+", "é", "12", "%", "_", "5500 0000 0000 0004"]
    texts = TEXTS[:4] + TEXTS[6:] + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 25))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], DOCS)
    for row in pii.find_personal_data(df).collect():
        want = base(texts[row.doc_id])
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert {x for x in joined.split(",") if x} <= set(row.spans.split(","))


def test_personal_data_of_very_long_texts(spark):
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(TEXTS[4:6])], DOCS)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[0].n_email == 1 and got[1].n_email == 1 and got[0].n_card == 0


def test_mail_candidates_of_any_length(spark):
    texts = [f"write to {'a' * n} [at] {'b' * n} [dot] org today" for n in (12, 65, 5000)] + ["mail x [at] y" + " [dot] z" * 30]
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], DOCS).withColumn("__pii_text", pii.F.col("text"))
    got = {r.doc_id: r["__pii_mail"] for r in pii._candidates(df).collect()}
    for i, n in enumerate((12, 65, 5000)):
        assert [(c.start, c.end) for c in got[i]] == [(9, 9 + 2 * n + 16)]
    assert [(c.start, c.end) for c in got[3]] == [(5, len(texts[3]))]


def test_numbers_side_by_side(spark):
    df = spark.createDataFrame([(0, "phone (212)555-0199 10 times", "x", 0.0)], DOCS)
    assert "phone:6:19" in pii.find_personal_data(df).first().spans
    assert pii.find_personal_data(df.where("false")).collect() == []


def test_boosted_trees_add_what_the_patterns_miss(spark):
    texts = ["please write to jo.miller [at] example [dot] org today", "phone: (212) 555-0199 at night", "on 2024-01-31 10:30:00", "order 1234567812345678 was sent", "nothing here at all dot"]
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert got[0].startswith("email:") and got[1].startswith("phone:") and got[2] == got[3] == got[4] == ""


def test_redaction(spark):
    rows = [(1, "to a@b.co and +12125550199!", "keep", 1.5), (2, None, "n", None), (3, "clean", None, 0.0), (4, "é 4111 1111 1111 1111", "x", 0.0)]
    got = pii.redact(spark.createDataFrame(rows, DOCS)).collect()
    assert [tuple(r) for r in got] == [(1, "to [EMAIL] and [PHONE]!", "keep", 1.5), (2, None, "n", None), (3, "clean", None, 0.0), (4, "é [CARD]", "x", 0.0)]


def test_native_plans_have_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.co", "x", 0.0)], DOCS)
    plan = pii.find_personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def secret_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24])


def test_secrets(spark):
    r = random.Random(2)
    pieces = ["password", "Api_Key", "TOKEN", "secret", "=", ": ", '"', "abc123", "AKIA" + "Q" * 16, "AKIAshort", "0123456789abcdef", "deadbeef", " ", "é", "x", "ſecret=abcdefgh"]
    texts = ["", None, "password=short", "a" * 60_000] + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 16))) for _ in range(150)]
    texts += ["key ghp_" + "aZ3kQ9xB" * 4 + "Xy12 end", "plain words with-hyphens-in-between-2024 and 1234567890123456"]
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x for x in secrets.find_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = secret_spans(t or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
    assert got[len(texts) - 2].n_added == 1 and got[len(texts) - 1].spans == ""
    assert secrets.find_secrets(df.where("false")).collect() == []


def test_long_tokens_are_scored_whole():
    r = random.Random(8)
    key = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    a = secrets.Automaton([secrets.classes(key(40)) for _ in range(50)])
    assert a.ends[0] == 50 or sum(a.ends) == 50
    assert sum(secrets.Automaton([secrets.classes(key(secrets.DEPTH + 9)) for _ in range(50)]).ends) == 0
    # the same beginning, 600 characters of it: what comes later decides
    digits, other = "0" * 600, "0" * 600 + "g" * 3000
    assert a.log_likelihood(other) < a.log_likelihood(digits) - 1
    state, total = 0, 0.0
    for c in other:  # the plain walk
        base = (a.totals.get(c, 0) + 0.5) / (a.all + 0.5 * a.symbols)
        total += np.log(base) if state is None else np.log((a.out[state].get(c, 0) + 2 * base) / (a.seen[state] + 2))
        state = None if state is None else a.next[state].get(c)
    assert a.log_likelihood(other) == pytest.approx(total / len(other))


def test_spans_clear_of_others():
    r = random.Random(4)
    for _ in range(300):
        spans = sorted((a, 0, a + r.randrange(1, 9)) for a in (r.randrange(60) for _ in range(r.randrange(8))))
        clear = secrets._clear_of(spans)
        for a in range(60):
            b = a + r.randrange(1, 9)
            assert clear(a, b) == (not any(x < b and a < y for x, _, y in spans))


def test_secrets_of_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token = abcdef123", "x", 0.0)] * 3 + [(None, "token: abcdef", "y", 1.0)], DOCS).withColumn("spans", pii.F.lit(1)).withColumn("unit", pii.F.lit(2))
    got = [(x.doc_id, x.n_assign, x.spans) for x in secrets.find_secrets(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, "assign:0:17")] * 3 + [(None, 1, "assign:0:13")], key=str)


def test_automata_tell_formats_apart():
    r = random.Random(3)
    key = lambda: "k" + "".join(r.choice("0123456789") for _ in range(12))
    word = lambda: "".join(r.choice("ghijk") for _ in range(13))
    a, b = secrets.Automaton([secrets.classes(key()) for _ in range(200)]), secrets.Automaton([secrets.classes(word()) for _ in range(200)])
    for s in (key(), key()):
        assert a.log_likelihood(secrets.classes(s)) > b.log_likelihood(secrets.classes(s))
    assert a.log_likelihood(secrets.classes(word())) < b.log_likelihood(secrets.classes(word()))


def test_language(spark):
    words = {"aa": ["the", "thing", "with", "under"], "bb": ["der", "schön", "über", "nicht"], "cc": ["ça", "être", "les", "deux"]}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(r.randrange(3, 40))), x) for i in range(300) for x in [r.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 + 3 !", "bb"), (1003, "ß", None), (1004, "的", None), (1005, "the " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    got = {x.doc_id: x for x in language.identify(df, model, "doc_id").collect()}
    held = [i for i, _, x in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004].lang_pred != "und" and got[1005].lang_pred == "aa"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert language.identify(df.where("false"), None, "doc_id").collect() == []
    assert {x.lang_pred for x in language.identify(df, None, "doc_id").collect()} == {"und"}


def test_language_with_repeated_ids_and_clashing_columns(spark):
    r = random.Random(9)
    words = {"aa": ["the", "thing", "with", "under"], "bb": ["der", "schön", "über", "nicht"]}
    for one in (7, 14):  # ids that may be learned from
        rows = [(one, " ".join(r.choice(words[x]) for _ in range(12)), x) for _ in range(400) for x in ("aa", "bb")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("unit", pii.F.lit("u")).withColumn("key", pii.F.lit(1)).withColumn("lang_pred", pii.F.lit("q"))
        if zlib.crc32(str(one).encode()) % 3 == 1:
            continue
        model = language.train(df)
        assert model is not None and model.languages == ["aa", "bb"]
        got = [x.lang_pred for x in language.identify(df.drop("lang_pred"), model, "doc_id", "lang").collect()]
        assert got == [x for _, _, x in rows]
    copies = spark.createDataFrame([(7, "the thing", "aa")] * 3000 + [(7, "der über", "bb")], "doc_id long, text string, lang string")
    assert language.train(copies).languages == ["aa", "bb"]


@pytest.mark.parametrize("most, least", [(768, 0.95), (60, 0.25)])
def test_more_than_200_languages(monkeypatch, most, least):
    monkeypatch.setattr(language, "MOST_LANDMARKS", most)
    r = random.Random(10)
    made = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for i in range(205)}
    texts, labels = zip(*[(" ".join(r.choice(w) for _ in range(30)), x) for x, w in made.items() for _ in range(5)])
    model = language.fit(list(texts), list(labels))
    assert len(model.languages) == 205 and len(model.landmarks) == min(most, 615)
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    best, _ = model.predict(data, off)
    assert np.mean([model.languages[b] == y for b, y in zip(best, labels)]) > least and len(set(best.tolist())) > 150 * least


def test_language_scores_equal_exact_kernel_ridge():
    r = random.Random(2)
    words = {"aa": ["the", "thing", "with", "under"], "bb": ["der", "schön", "über", "nicht"], "cc": ["ça", "être", "les", "deux"]}
    texts, labels = zip(*[(" ".join(r.choice(words[x]) for _ in range(r.randrange(2, 9))), x) for x in words for _ in range(14)])

    def grams(t):
        c = [int(language.BYTE_CLASS[b]) for b in t.encode()]
        return {(1, c[i], c[i - 1] if i else 0) for i in range(len(c))} | {(3, *c[i - 2 : i + 1]) for i in range(2, len(c))}

    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if x == z else -1.0 for z in sorted(words)] for x in labels])
    w = np.full(len(texts), 1 / 14)
    alpha = np.linalg.solve(k + 1 + language.RIDGE * np.diag(1 / w), y)  # all texts are landmarks: the dual solution
    model = language.fit(list(texts), list(labels))
    raw = [t.encode() for t in texts]
    got = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    assert got == pytest.approx((k + 1) @ alpha, abs=0.01)


def test_language_presence_equals_brute_force():
    texts = ["Ab cé", "", "b", "éé zz"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    column = np.arange(1, language.IDS + 1, dtype=np.int32)
    got = language.presence(data, off, column, *language._ids(data), language.IDS + 1)
    for t, row in zip(raw, got, strict=True):
        c = [int(language.BYTE_CLASS[b]) for b in t]
        want = {c[i] + 64 * (c[i - 1] if i else 0) for i in range(len(c))} | {4096 + c[i] + 64 * c[i - 1] + 4096 * c[i - 2] for i in range(2, len(c))}
        assert set((np.flatnonzero(row) - 1).tolist()) == want


def test_toxicity(spark):
    r = random.Random(6)
    plain = ["river", "stone", "tree", "house", "green", "walk", "sea", "cloud", "bird"]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(plain) + r.choice(["", "s", "ed"]) for _ in range(r.randrange(10, 120))]
        bad = r.random() < 0.3
        for _ in range(3 * bad):
            w[r.randrange(len(w))] = r.choice(["blargh", "Fnord", "zugzug"])
        rows.append((i, " ".join(w), "x", 0.0))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (2000, None, "x", 0.0), (2001, "", "x", 0.0), (2002, "river " * 20_000, "x", 0.0)], DOCS)
    toxicity_labels = spark.createDataFrame([*labels, (2001, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(docs, toxicity_labels)
    got = {x.doc_id: x.score for x in toxicity.score(docs, net, "doc_id", "base").collect()}
    held = [(y, got[i]) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for y, s in held]) > 0.95
    assert got[2000] == got[2001] < 0.5 and got[2002] < 0.5
    none = toxicity.train(docs, toxicity_labels.where("toxic = 0"))
    assert max(x.score for x in toxicity.score(docs, none, "doc_id").collect()) < 0.01


def test_toxicity_of_repeated_ids_and_edges(spark):
    r = random.Random(16)
    plain = ["river", "stone", "tree", "house", "green", "walk"]
    text = lambda bad: " ".join([r.choice(plain) for _ in range(30)] + ["blargh"] * 3 * bad)
    rows = [(i, text(i % 3 == 0), "x", 0.0) for i in range(600)]
    rows += [(i, "tree " * 30_000, "x", 0.0) for i in range(600, 900)] + [rows[1]] * 50 + [(1, text(0), "y", 1.0)]
    labels = [(i, int(i % 3 == 0)) for i in range(900)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", pii.F.lit(0)).withColumn("toxic", pii.F.lit("t"))
    net = toxicity.train(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    again = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(2))
    assert (net.text == again.text).all()
    got = {(x.doc_id, x.text): x.score for x in toxicity.score(docs.where("doc_id < 600"), net, "doc_id", "text").collect()}
    assert np.mean([(v >= 0.5) == ("blargh" in t) for (_, t), v in got.items()]) > 0.95
    empty = docs.where("false")
    assert toxicity.score(empty, net, "doc_id").collect() == []
    assert toxicity.score(docs.limit(1), toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")), "doc_id").first().score < 0.01


def test_network_equals_a_plain_loop():
    net = toxicity.Network(3)
    r = np.random.default_rng(4)
    for k in ("bf", "bb"):
        net.p[k] = r.normal(size=net.p[k].shape).astype(np.float32)
    net.text, net.usual = r.normal(size=toxicity.N_FEATURES), -0.3
    net.word_of[:] = r.integers(0, 50, len(net.word_of))
    net.gram_of[:] = r.integers(0, 50, len(net.gram_of))
    net.words, net.chars = (r.normal(size=(50, 8)).astype(np.float32) for _ in range(2))
    texts = ["one two three", "", " ".join(f"w{i}x{i % 7}" for i in range(70)), "a"]
    data, off = toxicity._bytes(texts)
    sig = lambda x: 1 / (1 + np.exp(-x))
    u = toxicity.UNITS

    def gru(xs, side):
        h, out = np.zeros(u), []
        for x in xs:
            g, a = x @ net.p["W" + side] + net.p["b" + side], h @ net.p["U" + side]
            z, m = sig(g[:u] + a[:u]), sig(g[u : 2 * u] + a[u : 2 * u])
            n = np.tanh(g[2 * u :] + m * a[2 * u :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    for i, t in enumerate(texts):
        d, o = toxicity._bytes([t])
        words = toxicity.Words(d, o, toxicity.NON_ALNUM)
        v = toxicity.Vocabulary(words)
        x = net.inputs(v)[v.of] if len(v.of) else np.zeros((0, 16))
        logits = []
        for a in range(0, max(1, len(x) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if len(x) else []:
            part = x[a : a + toxicity.WINDOW].astype(float)
            h = np.hstack([gru(part, "f"), gru(part[::-1], "b")[::-1]])
            e = np.exp(h @ net.p["v"])
            logits.append(float((e / e.sum()) @ h @ net.p["w"] + net.p["b"][0]))
        rise = sorted((max(z - net.usual, 0) for z in logits), reverse=True)
        want = [1, *(rise + [0, 0, 0])[:3], np.log1p(sum(rise)), np.log1p(len(x)) - 5]
        assert net.features(data, off)[i] == pytest.approx(want, abs=2e-3), t
        assert net.scores(data, off)[i] == pytest.approx(sig(np.dot(want, net.text)), abs=2e-3)


def test_toxicity_of_a_rare_language():
    r = random.Random(11)
    made = lambda n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]
    main, rare = (made(300), made(4)), (made(300), made(12))

    def text(language, bad):
        w = [r.choice(language[0]) for _ in range(r.randrange(20, 60))]
        for _ in range(2 * bad):
            w[r.randrange(len(w))] = r.choice(language[1])
        return " ".join(w)

    # each insult of the rare language is in fewer than 0.8% of the texts
    y = np.array([int(i % 10 == 0) for i in range(2300)])
    texts = [text(main if i < 1700 else rare, b) for i, b in enumerate(y)]
    assert max(sum(w in t for t in texts) for w in rare[1]) < 0.008 * len(texts)
    net = toxicity.fit(texts, y, np.ones(len(y)))
    words = toxicity.Vocabulary(toxicity.Words(*toxicity._bytes([" ".join(rare[1])]), toxicity.NON_ALNUM)).word
    assert np.mean(net.word_of[words] > 0) >= 0.75
    for language in (main, rare):
        for bad in (0, 1):
            got = net.scores(*toxicity._bytes([text(language, bad) for _ in range(50)])) >= 0.5
            assert np.mean(got == bool(bad)) >= 0.9


def test_network_gradients():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    x = r.normal(size=(7, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    idx = r.integers(0, 7, (toxicity.WINDOW, 5))
    mask = np.arange(toxicity.WINDOW)[:, None] < np.array([24, 3, 10, 1, 17])
    y, w = np.array([1, 0, 1, 0, 1.0]), np.ones(5)

    def loss():
        z = net.forward((x @ net.p["Wf"] + net.p["bf"])[idx], (x @ net.p["Wb"] + net.p["bb"])[idx], mask).astype(float)
        return np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)

    g, dx = net.gradients(x, idx, mask, y, w)
    for name in ("Uf", "Ub", "Wf", "v", "w", "bb"):
        flat = net.p[name].reshape(-1)
        k = int(np.abs(g[name]).argmax())
        keep, e = flat[k], 1e-2
        flat[k] = keep + e
        up = loss()
        flat[k] = keep - e
        down = loss()
        flat[k] = keep
        assert abs((up - down) / (2 * e) - g[name].reshape(-1)[k]) < 0.02 * max(0.02, abs(g[name]).max())


def test_windows_cover_all_words():
    first = np.array([0, 0, 1, 24, 50, 200])
    doc, a, b = toxicity.windows(first)
    for i in range(5):
        seen = set().union(*[set(range(x, y)) for d, x, y in zip(doc, a, b, strict=True) if d == i], set())
        assert seen == set(range(first[i], first[i + 1]))


def test_mixing(spark):
    r = random.Random(7)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), r.choice(["a", "b", "c", "d", None])) for i in range(800)]
    rows += [(900, None, "a"), (901, "", "e"), (None, "one two", "a"), (1, rows[1][1], rows[1][2])] + [(1000 + i, "x y z", "tiny") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", pytest.importorskip("pyspark.sql.functions").lit("x"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 3 * x.size for x in got)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, float(total)
    while True:
        free = [s for s in order if s not in target]
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left = total - sum(target.values())
    by_size = {}
    for x in got:
        by_size.setdefault(x.source_size, [0, x.target])[0] += x.taken
    for s in order:
        taken, t = by_size[sizes[s]]
        if len([x for x in sizes.values() if x == sizes[s]]) == 1:
            assert t == pytest.approx(target[s]) and abs(taken - t) <= max(60, 0.01 * t), s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    assert mixing.mix(df.where("false")).collect() == []


def test_mixing_rates_are_the_optimum(spark):
    r = random.Random(17)
    rows = [(i, r.choice("abcde"), r.randrange(0, 300) ** (1 + (i % 3 == 0))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("key", pii.F.xxhash64("doc_id"))
    df = mixing.materialise(df, "rows")
    got = mixing.with_copies(df, mixing.solve(df)).collect()
    for s in "abcde":
        own = [x for x in got if x.source == s and x["size"] > 0]
        sizes, rates, target = np.array([x["size"] for x in own], float), np.array([x.rate for x in own]), own[0].target
        assert (sizes * rates).sum() == pytest.approx(target, rel=1e-6)
        if target < 3 * sizes.sum() * (1 - 1e-9):
            # stationary: the logarithm of a rate that isn't cut is the multiplier times the size, and nothing else meets the target
            free = rates < 3
            tilt = np.log(rates[free]) / sizes[free]
            assert tilt == pytest.approx(np.full(free.sum(), tilt[0]), rel=1e-6, abs=1e-12)
            lo, hi = -1.0, 1.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (sizes * np.minimum(3, np.exp(np.minimum(mid * sizes, 50)))).sum() < target else (lo, mid)
            assert tilt[0] == pytest.approx(lo, rel=1e-5, abs=1e-9)
            assert (np.log(3) / tilt[0] <= sizes[~free].min() + 1e-6) if (~free).any() else True
        taken = sum(x["size"] * x.n_copies for x in own)
        assert abs(taken - target) <= sizes.max() and all(abs(x.n_copies - x.rate) < 1.2 for x in own)


def test_mixing_many_sources_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    rows = [(i, "w " * (1 + i % 9), f"s{i % 40:02}") for i in range(800)] + [(i, "w w", None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "rate", "key", "target", "number", "tilt"):
        df = df.withColumn(c, pii.F.lit("x"))
    got = mixing.mix(df).collect()
    order, total = [f"s{i:02}" for i in range(40)] + [None], sum(len(t.split()) for _, t, _ in rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in order}
    capped, share = set(), 0
    for _ in range(50):
        share = (total - sum(3 * sizes[s] for s in capped)) / sum((5, 2, 1)[i % 3] for i, s in enumerate(order) if s not in capped)
        capped |= {s for i, s in enumerate(order) if (5, 2, 1)[i % 3] * share > 3 * sizes[s]}
    want = sorted(3.0 * sizes[s] if s in capped else (5, 2, 1)[i % 3] * share for i, s in enumerate(order) for _ in [x for x in rows if x[2] == s])
    assert sorted(x.target for x in got) == pytest.approx(want)


def test_preference_format(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "else"), (2, 3, "assistant", "é"),
         (3, 0, "user", "hi"), (4, 0, "user", "alone"), (5, 1, "user", "later"), (5, 0, "system", None), (6, 0, "system", ""), (6, 1, "user", "later"), (None, 0, "user", "hi"), (7, None, "user", "hi"), (2, 3, "assistant", "é")]
    df = spark.createDataFrame(c, "conv_id long, turn long, role string, text string")
    got = {(x.chosen_id, x.rejected_id): x for x in chat.preferences(chat.paired(chat.conversations(df))).collect()}
    assert set(got) == {(1, 2), (5, 6)}
    x = got[1, 2]
    assert x.n_common == 2 and x.prompt == "<|user|>\nhi\n<|assistant|>\nyo\n"
    assert x.chosen == "<|user|>\nmore\n<|assistant|>\nlong answer\n"
    a, b = map(int, x.chosen_mask.split(":"))
    assert x.chosen[a:b] == "long answer"
    a, b = map(int, x.rejected_mask.split(":"))
    assert x.rejected[a:b] == "é"
    assert got[5, 6].n_common == 2 and got[5, 6].chosen == "" == got[5, 6].chosen_mask
    assert chat.preferences(chat.paired(chat.conversations(df.where("false")))).collect() == []
    stale = chat.preferences(chat.stale_replies(chat.conversations(df))).orderBy("chosen_id").collect()
    assert [(x.chosen_id, x.n_common) for x in stale] == [(1, 3), (2, 3)]
    assert stale[0].chosen == "<|assistant|>\nlong answer\n" and stale[0].rejected == "<|assistant|>\nyo\n"


def test_pairs_of_sparse_ids_with_one_first_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 7)
    ids = [i * i * 1_000_003 - 5000 for i in range(101)]
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", "hi" if t == 0 else f"{i}" * (1 + i % 3)) for i in ids for t in range(3)]
    rows.append((ids[0], 3, "user", "long " * 50_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", pii.F.lit(1)).withColumn("range", pii.F.lit("r")).withColumn("place", pii.F.lit(0))
    got = {frozenset((x.chosen_id, x.rejected_id)) for x in chat.paired(chat.conversations(df)).collect()}
    assert got == {frozenset(ids[i : i + 2]) for i in range(0, 100, 2)}
    assert any("long long" in x.chosen + x.rejected for x in chat.preferences(chat.paired(chat.conversations(df))).collect())


def test_pipeline_stages_on_odd_rows(spark, data, tmp_path):
    import corpus_pipeline as p

    bench = " ".join(f"b{i}" for i in range(20))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    clean, near = " ".join(f"a{i}" for i in range(50)), " ".join(f"a{i}" for i in range(49)) + " zz"
    rows = [(1, clean), (1, bench), (None, near), (None, bench), (2, None), (3, ""), (3, ""), (None, None), (4, "mail a.b@example.com " + "x" * 90_000), (5, clean), (1, clean)]
    df = spark.createDataFrame([(i, t, None, "s" if t else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = df.withColumn("key", pii.F.lit(1)).withColumn("size", pii.F.lit("x")).withColumn("row", pii.F.lit("x"))
    seen = lambda out: sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    where = str(tmp_path)
    assert seen(p.drop_toxic(spark, odd, where)) == sorted(rows, key=str)
    # of the group of clean and its near copies one row; of the two benchmark texts the one with an id
    empty = [(2, None), (3, ""), (3, ""), (None, None)]
    assert seen(p.one_of_each_group(spark, odd, where)) == sorted([(1, clean), (1, bench), rows[8], *empty], key=str)
    assert seen(p.drop_contaminated(spark, odd, where)) == sorted([r for r in rows if r[1] != bench], key=str)
    assert "[EMAIL]" in dict(seen(p.mask_personal_data(spark, odd, where)))[4]
    mixed = p.mix_sources(spark, odd, where)
    assert mixed.columns == [*p.COLUMNS, "n_copies"] and set(seen(mixed)) <= {r for r in rows if r[1]}
    for _, stage in p.STAGES:
        assert stage(spark, odd.where("false"), where).collect() == []


def test_pipeline(spark, data):
    import corpus_pipeline as p
    from driftlex.llm import decontaminate, ngram_join
    from driftlex.llm.scratch import materialise

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in p.STAGES:
        out = materialise(stage(spark, docs, data), f"test-{name}")
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        if name != "mixing":
            assert out.columns == p.COLUMNS
        if name == "ngram_join":
            assert set(after) == {r.doc_id for r in ngram_join.similar_documents(docs).where("doc_id = component_id").collect()}
        if name == "decontamination":
            assert before - set(after) == {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
        if name == "pii":
            assert not any(base(r.text) for r in out.collect())
        docs = out if name != "mixing" else docs
    assert all(r.n_copies in (1, 2, 3) for r in out.select("n_copies").distinct().collect())


def test_language_of_one_repeated_text_and_of_long_texts_only(spark):
    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "the cat and the dog sat on a mat " * (1 + i % 3), "en") for i in own[:60]]
    rows += [(own[70], "der hund und die katze", "de")] * 3000  # equal rows of one text
    rows += [(i, f"el perro {i} y la gata duermen " * 500, "es") for i in own[100:130]]  # over LONGEST characters each
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = language.train(df)
    assert model.languages == ["de", "en", "es"]
    told = {r["lang"]: r["right"] for r in language.identify(df, model, "doc_id", "lang").groupBy("lang").agg(F.min((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert told == {"de": 1, "en": 1, "es": 1}


def test_mixing_of_equal_rows_meets_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 64)
    rows = [(1, "one two three four five six seven eight", "a")] * 1000 + [(i, "w " * (1 + i % 40), "b") for i in range(2, 900)] + [(None, "x y", None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    for source_size in {r["source_size"] for r in out}:
        own = [r for r in out if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_personal_data_on_odd_rows(spark):
    text = "mail ann@example.com or call +1 (706) 555-3138, from 10.0.0.1"
    rows = [(1, text, "x", 0.0)] * 3 + [(None, text, "x", 0.0), (2, None, "x", 0.0), (3, "", "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, start double").withColumn("spans", pii.F.lit(1)).withColumn("n_email", pii.F.lit("x"))
    got = pii.find_personal_data(df).collect()
    assert len(got) == 6 and [(r.n_email, r.n_ip, r.n_phone) for r in got if r.doc_id in (2, 3)] == [(0, 0, 0)] * 2
    held = [tuple(r) for r in got if r.doc_id == 1]
    assert len(held) == 3 and len(set(held)) == 1 and held[0][1:] == next(tuple(r)[1:] for r in got if r.doc_id is None)
    masked = pii.redact(df).select("doc_id", "text", "kind", "start", "spans", "n_email").collect()
    assert len(masked) == 6 and {r.text for r in masked if r.doc_id in (1, None)} == {"mail [EMAIL] or call [PHONE], from [IP]"}
    assert all(r.kind == "x" and r.spans == 1 and r.n_email == "x" for r in masked) and {r.text for r in masked if r.doc_id in (2, 3)} == {None, ""}


def test_a_long_text_of_many_addresses(spark):
    text = " ".join(f"user{i}@example.com" for i in range(1200))
    r = pii.find_personal_data(spark.createDataFrame([(1, text, "x", 0.0)], DOCS)).first()
    at = [(m.start(), m.end()) for m in re.finditer(r"user\d+@example\.com", text)]
    assert r.n_email == 1200 and r.base_sha256 == hashlib.sha256(",".join(f"email:{a}:{b}" for a, b in at).encode()).hexdigest()
