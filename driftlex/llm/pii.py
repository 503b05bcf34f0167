"""Personal data with DataFrame functions only: candidates, boosted trees, calibrated thresholds.

Fixed patterns give base spans, which always stay. High-recall generators
propose further, overlapping candidates (obfuscated addresses; every run of
digits and separators, and every part of it without blanks, as address, card
and phone at once). Boosted trees, one set for each kind, score a candidate's
format and context; those above the kind's calibrated threshold are added
where no base span lies, the longer of two that overlap.

The trees are fitted on the driver, in plain Python, on features that the same
column expressions give for a generated, labelled set of ``EXAMPLES`` texts.
They become CASE expressions; the scan of the table is one narrow stage.
"""

from __future__ import annotations

import math
import random
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LABEL = r"[A-Za-z0-9-]++"
_LOCAL = "A-Za-z0-9._%+-"
# Possessive forms of the plain patterns; a match can't begin inside a run whose beginning failed, unless another ended there.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[(\[]\x20?at\x20?[)\]]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?|\x20dot\x20|\.)"
PROPOSED = {
    "mail": rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}{_LABEL}(?:{_DOT}{_LABEL})++",
    "digits": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20()./:-]{0,2}+[0-9])++",
    # within those runs what has no blank inside: numbers that stand side by side
    "tight": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[()./:-]{0,2}+[0-9])++",
}
CUES = {
    "call": r"phone|call|tel\b|telefon|téléphone|mobile|fax|whatsapp|sms",
    "pay": r"card|visa|master|amex|credit|carte|karte|tarjeta",
    "net": r"\bip\b|host|server|address|login|addr",
    "code": r"isbn|order|invoice|version|ref|serial|\bno\b|nr|date|page|\bid\b|build|release",
}
CONTEXT = 24
EXAMPLES, ROUNDS, DEPTH, RATE = 2400, 14, 3, 0.35
LEAST_PRECISION = 0.98
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the Luhn check."""
    d = F.reverse(_digits(v))

    def step(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), step) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(v))
    if kind == "phone":
        return n.between(10, 15)
    # the check is made on strings of a card's length only
    return F.when(n.between(14, 19), luhn(v)).otherwise(False)


def _with_spans(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Column ``name``: array of (start, end, value) of the pattern's matches in ``__pii_text``."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    df = df.withColumn("__pii_m", F.regexp_extract_all("__pii_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("__pii_g", F.when(F.size("__pii_m") > 0, F.transform(F.split("__pii_text", pattern, -1), lambda g: F.length(g))))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    pairs = F.zip_with("__pii_m", F.slice("__pii_g", F.lit(1), F.size("__pii_m")), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    folded = F.aggregate(
        pairs,
        start,
        lambda a, p: F.struct(
            (a["at"] + p["g"] + F.length(p["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + p["g"]).alias("start"), (a["at"] + p["g"] + F.length(p["m"])).alias("end"), p["m"].alias("value")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return df.withColumn(name, F.when(F.size("__pii_m") > 0, folded).otherwise(none)).drop("__pii_m", "__pii_g")


FEATURES = ("digits", "chars", "plus", "paren", "dots", "dashes", "blanks", "slashes", "colons", "luhn", "quad", "groups", "last", "lead", "letters", "at", *CUES)


def _features(c: Column) -> list[Column]:
    """Format and context of a candidate, as integers."""
    v = c["value"]
    before = F.lower(F.substring(F.col("__pii_text"), F.greatest(c["start"] - CONTEXT + 1, F.lit(1)), F.least(c["start"], F.lit(CONTEXT))))
    count = lambda x: F.length(v) - F.length(F.replace(v, F.lit(x), F.lit("")))
    n = F.length(_digits(v))
    groups = F.split(v, r"[^0-9]+")
    return [
        F.least(n, F.lit(40)),
        F.least(F.length(v), F.lit(80)),
        v.startswith("+").cast("int"),
        v.contains("(").cast("int"),
        count("."),
        count("-"),
        count(" "),
        count("/"),
        count(":"),
        F.when(n.between(12, 19), luhn(v)).otherwise(False).cast("int"),
        v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}(?::[0-9]+)?$").cast("int"),
        F.least(F.size(groups), F.lit(12)),
        F.least(F.length(F.element_at(groups, -1)), F.lit(20)),
        F.least(F.length(F.regexp_extract(v, r"([0-9]+)", 1)), F.lit(20)),
        v.rlike("[A-Za-z]").cast("int"),
        F.lower(v).rlike(r"[(\[]\s?(?:at|dot)").cast("int"),
        *[before.rlike(p).cast("int") for p in CUES.values()],
    ]


def _candidates(df: DataFrame) -> DataFrame:
    """Columns ``__pii_mail``, ``__pii_digits`` and ``__pii_tight``: proposed spans with ``f``, their features."""
    for key, pattern in PROPOSED.items():
        name = f"__pii_{key}"
        df = _with_spans(df, name, pattern)
        if key != "mail":
            df = df.withColumn(name, F.filter(name, lambda c: F.length(_digits(c["value"])) >= 7))
        df = df.withColumn(name, F.transform(name, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array(*_features(c)).alias("f"))))
    return df


def _examples(seed: int) -> list[tuple[str, str, int, int]]:
    """(text, kind or 'none', start, end): generated texts around one labelled string each."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = r.choice

    def card(n):
        body = pick(["4", "51", "37", "6011"]) + d(n)
        body = body[: n - 1]
        for x in "0123456789":
            digits = [int(c) for c in (body + x)[::-1]]
            if sum(digits[::2] + [2 * c - 9 * (c > 4) for c in digits[1::2]]) % 10 == 0:
                return body + x
        return body

    octets = lambda: [str(r.randrange(1, 255)) for _ in range(4)]
    word = lambda: "".join(pick("aeioulnrstdm") for _ in range(r.randrange(2, 9)))

    def grouped(s, sizes, sep):
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(out)

    def phone():
        sep = pick(" -.")
        return pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"0{d(2)}/{d(7)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(7)}"])

    def cards():
        n = card(16)
        return pick([n, grouped(n, (4, 4, 4, 4), pick(" -./")), grouped(card(15), (4, 6, 5), pick(" -."))])

    def mail():
        dot = pick([" dot ", " [dot] ", "(dot)", "."])
        at = pick([" (at) ", " [at] ", "[at]", "(at)"] + [" at "] * (dot != "."))
        return f"{word()}{pick(['.', '_', ''])}{word()}{at}{word()}{dot}{pick(['com', 'org', 'de', 'net'])}"

    def none():
        bad = list(card(16))
        bad[r.randrange(15)] = pick("0123456789")
        y, m, k = r.randrange(1950, 2030), r.randrange(1, 13), r.randrange(1, 29)
        return pick(
            [
                f"{y}-{m:02}-{k:02}", f"{k:02}/{m:02}/{y}", f"{k:02}.{m:02}.{y} {r.randrange(24):02}:{r.randrange(60):02}", f"{y}-{m:02}-{k:02} {r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}",
                d(16), d(r.randrange(7, 25)), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}.{d(3)}.{d(3)}.{d(3)}", f"{d(2)}.{d(1)}.{d(4)}", f"{y}-{y + 4}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", grouped("".join(bad), (4, 4, 4, 4), " "),
                f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"{d(8)}", f"{d(10)}", f"{d(12)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}",
            ]
        )

    cue = {"phone": ["call", "phone:", "tel", "fax", "mobile"], "card": ["card", "visa", "credit card", "paid with"], "ip": ["server", "host", "from ip", "address"], "email": ["write to", "contact", "mail"], "none": ["order", "invoice", "isbn", "version", "ref", "on date", "page", "id"]}
    make = {"phone": phone, "card": cards, "ip": lambda: ".".join(octets()) + pick(["", f":{d(4)}"]), "email": mail, "none": none}
    out = []
    for _ in range(EXAMPLES):
        kind = pick(["phone", "card", "ip", "email", "none", "none", "none", "none"])
        value = make[kind]()
        lead = " ".join(word() for _ in range(r.randrange(1, 5)))
        lead += f" {pick(cue[kind])} " if r.random() < 0.6 else f" {pick(cue[pick(KINDS)])} " if r.random() < 0.1 else " "
        if kind == "phone" and value[0] not in "+(" and r.random() < 0.9:
            lead = f"{word()} {pick(cue['phone'])} "
        out.append((f"{lead}{value}{pick([' ', '. ', ', ', '.'])}{word()}", kind, len(lead), len(lead) + len(value)))
    return out


def _tree(rows: list[tuple], g: list[float], h: list[float], index: list[int], depth: int):
    """A regression tree by gain: nested (feature, cut, low, high), or a leaf's value."""
    total, weight = sum(g[i] for i in index), sum(h[i] for i in index)
    best = (1e-3, None, None)
    if depth:
        for f in range(len(rows[0])):
            sums: dict[int, list[float]] = {}
            for i in index:
                s = sums.setdefault(rows[i][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            a = b = 0.0
            for x in sorted(sums)[:-1]:
                a, b = a + sums[x][0], b + sums[x][1]
                if b > 1 and weight - b > 1:
                    gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total**2 / (weight + 1)
                    if gain > best[0]:
                        best = (gain, f, x)
    _, f, x = best
    if f is None:
        return RATE * total / (weight + 1)
    low, high = [i for i in index if rows[i][f] <= x], [i for i in index if rows[i][f] > x]
    return f, x, _tree(rows, g, h, low, depth - 1), _tree(rows, g, h, high, depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(rows: list[tuple], y: list[int], fit_on: list[int]) -> list:
    """Gradient boosting of the logistic loss; the first entry is the prior's log-odds."""
    p = (sum(y[i] for i in fit_on) + 1) / (len(fit_on) + 2)
    trees, score = [math.log(p / (1 - p))], [math.log(p / (1 - p))] * len(rows)
    for _ in range(ROUNDS):
        q = [1 / (1 + math.exp(-s)) for s in score]
        t = _tree(rows, [a - b for a, b in zip(y, q, strict=True)], [max(b * (1 - b), 0.05) for b in q], fit_on, DEPTH)
        trees.append(t)
        score = [s + _value(t, r) for s, r in zip(score, rows, strict=True)]
    return trees


@cache
def _fitted(spark: SparkSession, seed: int = 5) -> dict[str, tuple[list, float]]:
    """kind: (trees, threshold on the log-odds)."""
    made = _examples(seed)
    df = spark.createDataFrame(made, "__pii_text string, kind string, start int, end int")
    got = _candidates(df).select("kind", "start", "end", "__pii_mail", F.array_union("__pii_digits", "__pii_tight").alias("__pii_digits")).collect()
    models = {}
    for kind in KINDS:
        rows, y = [], []
        for r in got:
            for c in r["__pii_mail" if kind == "email" else "__pii_digits"]:
                rows.append(tuple(c["f"]))
                y.append(int(r["kind"] == kind and abs(c["start"] - r["start"]) <= 1 and abs(c["end"] - r["end"]) <= 1))
        fit_on, check = [i for i in range(len(rows)) if i % 3], [i for i in range(len(rows)) if not i % 3]
        trees = boost(rows, y, fit_on)
        scored = sorted(((trees[0] + sum(_value(t, rows[i]) for t in trees[1:]), y[i]) for i in check), reverse=True)
        threshold, hit = math.inf, 0
        for n, (s, ok) in enumerate(scored, 1):
            hit += ok
            if hit >= LEAST_PRECISION * n and s > 0:
                threshold = s
        models[kind] = (trees, threshold)
    return models


def _sql(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[tree[0]] <= tree[1], _sql(tree[2], f)).otherwise(_sql(tree[3], f))


def _log_odds(trees: list, f: Column) -> Column:
    total = F.lit(float(trees[0]))
    for t in trees[1:]:
        total = total + _sql(t, f)
    return total


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _place(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))


def with_personal_data(docs: DataFrame) -> DataFrame:
    """docs with ``__pii_base`` and ``__pii_added``: arrays of (start, kind, end), kind being its place in ``KINDS``; sorted.

    A null text counts as empty and has none. Positions are code points, ends exclusive.
    """
    models = _fitted(docs.sparkSession)
    df = docs.withColumn("__pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS:
        df = _with_spans(df, f"__pii_{kind}", BASE[kind])
        df = df.withColumn(f"__pii_{kind}", F.filter(f"__pii_{kind}", _check(kind)))
    df = df.withColumn("__pii_base", F.array_sort(F.concat(*[F.transform(f"__pii_{kind}", _place(k)) for k, kind in enumerate(KINDS)])))
    df = _candidates(df)
    clear = lambda s, of: ~F.exists(of, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    trees, threshold = models["email"]
    if math.isfinite(threshold):
        df = df.withColumn("__pii_mail", F.filter("__pii_mail", lambda c: clear(c, "__pii_base") & (_log_odds(trees, c["f"]) >= threshold)))
        df = df.withColumn("__pii_mail", F.transform("__pii_mail", _place(0)))
    else:
        df = df.withColumn("__pii_mail", F.slice("__pii_base", 1, 0))

    def kind_of(c):
        margins = [(k, _log_odds(models[kind][0], c["f"]) - F.lit(models[kind][1])) for k, kind in enumerate(KINDS) if kind != "email" and math.isfinite(models[kind][1])]
        best = F.array_max(F.array(*[F.struct(m.alias("margin"), F.lit(k).alias("kind")) for k, m in margins]))
        return F.struct(c["start"].alias("start"), best["kind"].alias("kind"), c["end"].alias("end"), best["margin"].alias("margin"))

    df = df.withColumn("__pii_added", F.col("__pii_mail"))
    for name in ("__pii_digits", "__pii_tight"):
        df = df.withColumn(name, F.filter(name, lambda c: clear(c, "__pii_base") & clear(c, "__pii_added")))
        df = df.withColumn(name, F.filter(F.transform(name, kind_of), lambda c: c["margin"] >= 0))
        df = df.withColumn("__pii_added", F.concat("__pii_added", F.transform(name, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))
    return df.withColumn("__pii_added", F.array_sort("__pii_added")).drop("__pii_mail", "__pii_digits", "__pii_tight")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id``, numbers of base spans, their digest, and all spans as text.

    Null and empty texts have no spans; texts of any length are scanned whole, in time that rises with their
    length and, by a small part, with the square of the number of their spans. A null ``doc_id`` stays null. Repeated rows are judged each by itself; other columns, whatever
    their names, are ignored. An empty table gives an empty result.
    """
    df = with_personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return df.select(
        "doc_id",
        *[F.size(f"__pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("__pii_base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("__pii_base", "__pii_added"))).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in ``text`` replaced by its kind in brackets, and ``n_chars`` as it then is.

    Null and empty texts stay as they are; texts of any length are masked whole, repeated rows each by itself. All
    other columns stay, whatever their names, but for such as begin with ``__pii_``. An empty table gives an empty result.
    """
    columns = docs.columns
    df = with_personal_data(docs).withColumn("__pii_all", F.array_sort(F.concat("__pii_base", "__pii_added")))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        apart = s["start"] >= a["at"]
        piece = F.array(F.substring(F.col("__pii_text"), a["at"] + 1, s["start"] - a["at"]), tags[s["kind"]])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(apart, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(F.col("__pii_text"), a["at"] + 1, F.length("__pii_text")))), "")
    text = F.when(F.col("text").isNull() | (F.size("__pii_all") == 0), F.col("text").cast("string")).otherwise(F.aggregate("__pii_all", start, step, rest))
    df = df.withColumn("__pii_new", text)
    return df.select(*[F.col("__pii_new").alias(c) if c == "text" else F.length("__pii_new").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
